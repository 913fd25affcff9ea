"""Distributed models with MLlib (ML-3..13): feature assembly, boosted trees,
forests, cross-validation, grid search, feature selection, rebalancing by
class weights, scaling and exact linear attribution.

Training data is one row per customer; the assembled frame is persisted for
the iterative fits and released afterwards.  Scores are joined back by the
true customer id (never by position).
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool
from statistics import median

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import hashing as H
from ..functions.ranking import auc_from_scores
from ..session import growing
from .clean import numeric_columns
from .metrics import split_columns
from .search import abreast, best_point, dealt, search


def feature_names(df: DataFrame, key: str = S.ID_COL, label: str = "label",
                  exclude=(S.TARGET_COL,)) -> list[str]:
    return numeric_columns(df, (key, label, *exclude))


def assemble(df: DataFrame, features: list[str], key: str = S.ID_COL, label: str = "label") -> DataFrame:
    """(key, label, features vector); nulls become 0 first (the original's
    final zero fill), so no row is dropped."""
    filled = df.select(key, F.col(label).cast("double").alias("label"),
                       *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled) \
        .select(key, "label", "features")


def with_split(df: DataFrame, key: str = S.ID_COL) -> DataFrame:
    """ML-1: stratified test split of exact size (first 20 % of each class in hash order) and hash folds."""
    sides = split_columns(df.select(key, "label"), key, "label") \
        .select(F.col(key).alias("_key"), F.col("is_test_exact").alias("is_test"), "fold")
    return growing(df).join(sides, F.col(key) == F.col("_key")).drop("_key")


def boosted(params: dict | None = None, **over) -> GBTClassifier:
    """ML-3: boosted trees with the original defaults (100 trees, depth 6, lr 0.1,
    row and column subsampling 0.8, seed 42).  Rows find their node from the root: node numbers kept between
    levels would be written anew for every row and level, which takes longer than a few comparisons."""
    p = dict(S.BOOSTED_PARAMS, cacheNodeIds=False)
    p.update(params or {})
    p.update(over)
    return GBTClassifier(featuresCol="features", labelCol="label", **p)


def forest(trees: int = 100, seed: int = S.SPLIT_SEED, **over) -> RandomForestClassifier:
    """ML-4 / ML-5: random forest baseline; no node numbers are kept (one per row and tree, for several levels)."""
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, seed=seed,
                                  cacheNodeIds=False, **over)


def p_default(scored: DataFrame) -> DataFrame:
    """P(default) = probability of class 1, as a plain double column."""
    return scored.withColumn("p_default", vector_to_array("probability")[1])


def evaluate(scored: DataFrame, label: str = "label") -> dict:
    """AUC (exact, distributed) and accuracy / majority rate at 0.5: one small row each."""
    auc = auc_from_scores(scored, label, "p_default").first()["auc"]
    acc = scored.agg(F.avg(((F.col("p_default") >= 0.5).cast("double") == F.col(label)).cast("double")).alias("a"),
                     F.avg(F.col(label)).alias("pos")).first()
    return {"auc": auc, "accuracy": acc["a"], "majority_rate": max(acc["pos"], 1 - acc["pos"])}


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Feature importances of a tree model as (name, value) pairs (one per feature)."""
    v = model.featureImportances.toArray()
    return [(f, float(v[i])) for i, f in enumerate(features)]


def select_by_median_importance(imp: list[tuple[str, float]]) -> list[str]:
    """ML-10: keep features whose importance is at least the median importance."""
    m = median(v for _, v in imp)
    return [f for f, v in imp if v >= m]


def cross_validated_auc(frame: DataFrame, estimator, folds: int = 5, parallelism: int = 5) -> list[float]:
    """ML-8: hash folds on the training rows; fit on the other folds, exact AUC on
    the held-out fold.  Up to ``parallelism`` folds are fitted at a time: a fit is a long
    chain of small jobs, which leaves most of a cluster idle on its own; folds of many tasks fill it, and their
    binned rows, several times the frame, would push each other out of memory."""
    kept = persist(dealt(frame))
    width = abreast(frame.sparkSession, kept.count(), parallelism)

    def auc_of(k: int):
        model = estimator.fit(kept.filter(F.col("fold") != k))
        scored = p_default(model.transform(kept.filter(F.col("fold") == k)))
        return auc_from_scores(scored, "label", "p_default").first()["auc"]

    try:
        with ThreadPool(width) as pool:
            return pool.map(auc_of, range(folds), 1)
    finally:
        kept.unpersist()


# The original grids, in MLlib parameter names (rounds -> maxIter,
# learning rate -> stepSize, row subsample -> subsamplingRate, column subsample ->
# featureSubsetStrategy, min child weight -> minInstancesPerNode as a stand-in).
TRAINING_GRID = {"maxIter": [50, 100, 200], "maxDepth": [3, 6, 9], "stepSize": [0.01, 0.1, 0.2],
                 "subsamplingRate": [0.8, 0.9, 1.0]}                                   # ML-6, 81 points
FULL_GRID = {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.2],
             "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": ["0.8", "1.0"],
             "minInstancesPerNode": [1, 3]}                                            # ML-7, 216 points


# The grid that the original takes for small tables.
SMALL_GRID = {"maxIter": [50, 100], "maxDepth": [3, 5], "stepSize": [0.1]}


def tuned(frame: DataFrame, estimator, grid: dict, folds: int = 5, parallelism: int = 4, key: str | None = None,
          prepare=None):
    """ML-6 / ML-7: grid search with shared prefixes over balanced folds; (model fitted on all rows with the
    best parameters, these parameters).  ``prepare``: applied to training rows only.  A failure is not caught."""
    key = key or frame.columns[0]
    best = best_point(search(frame, estimator, grid, folds, key, parallelism, prepare))
    chosen = estimator.copy({estimator.getParam(n): v for n, v in best.items()})
    return fit_persisted(chosen, prepare(frame) if prepare else frame), best


def compare_models(train: DataFrame, test: DataFrame, estimators: dict) -> list[tuple[str, float]]:
    """ML-9: exact test AUC of each estimator."""
    out = []
    for name, est in estimators.items():
        scored = p_default(est.fit(train).transform(test))
        out.append((name, float(auc_from_scores(scored, "label", "p_default").first()["auc"] or 0.0)))
    return out


def class_weights(frame: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """ML-11 (weighting form): each class weighted to parity, n / (2 * n_class);
    one aggregate row, no row is copied or dropped."""
    c = frame.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("pos")).first()
    n, pos = c["n"], c["pos"] or 0
    neg = n - pos
    w1 = n / (2.0 * pos) if pos else 1.0
    w0 = n / (2.0 * neg) if neg else 1.0
    return frame.withColumn(out, F.when(F.col(label) == 1, F.lit(w1)).otherwise(F.lit(w0)))


def scaler(features_col: str = "features", out: str = "scaled") -> StandardScaler:
    """ML-13: standardisation (mean 0, unit sample std)."""
    return StandardScaler(inputCol=features_col, outputCol=out, withMean=True, withStd=True)


def linear_attributions(frame: DataFrame, features: list[str], key: str = S.ID_COL, train: DataFrame | None = None):
    """EXP-1 (linear form): a logistic model on standardised features, learned from
    ``train`` (all of ``frame`` where None); each row's contribution of feature j is coef_j * z_j (z has training mean 0),
    so base (intercept) + sum(contributions) = the row's logit exactly."""
    pipe = Pipeline(stages=[scaler(), LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=100,
                                                         regParam=0.01)])
    model = pipe.fit(frame if train is None else train)
    lr = model.stages[-1]
    coef = lr.coefficients.toArray().tolist()
    z = vector_to_array(F.col("scaled"))
    out = model.transform(frame).select(
        key, "label", F.lit(float(lr.intercept)).alias("base_value"),
        *[(z[i] * F.lit(float(c))).alias(f"c_{f}") for i, (f, c) in enumerate(zip(features, coef))],
        vector_to_array("rawPrediction")[1].alias("logit"))
    return out, model


def persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fit_persisted(estimator, train: DataFrame):
    """Fit on a persisted copy of the training rows, in tasks of bounded size, and release it afterwards."""
    kept = persist(dealt(train))
    try:
        return estimator.fit(kept)
    finally:
        kept.unpersist()
