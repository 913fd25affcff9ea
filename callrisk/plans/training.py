"""Queries of the training stage: oversampling (ML-11, JN-5), grid search (ML-7) and tree attributions (EXP-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import auc_from_scores
from .. import schema as S
from ..operators import explain as X
from ..operators import models as MD
from ..operators import neighbours as NB
from ..operators import oversample as OS
from ..operators import search as SE
from ..operators import trees as TR
from ..operators.metrics import split_columns
from ..session import growing, passing, stored
from .common import r6
from .oracle import r6 as x6
from .models import boosted_model, model_frame
from .prepare import _MEANFILL_FEATS, _mean_filled_sql, q_mean_filled_features

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def training_calls(spark, d):
    """Call-grain features of the optimisation run with ``is_test`` (exact stratified split), written once:
    the split, the neighbours and the synthetic rows all read them."""
    with passing(spark):
        with passing(spark):
            calls = stored(q_mean_filled_features(spark, d), "training-calls", keep=True)
        sides = split_columns(calls.select("contact_id", "label"), "contact_id").select("contact_id", "is_test_exact")
        return stored(growing(calls).join(sides, "contact_id").withColumnRenamed("is_test_exact", "is_test"), "training-sides",
                      keep=True)


def parity_frame(calls, key="row_no"):
    """The calls and the synthetic ones of the smaller class, written in files of a task's rows and assembled."""
    rows = stored(OS.oversampled(calls, _MEANFILL_FEATS, "contact_id"), "oversampled", keep=True, task_rows=SE.TASK_ROWS)
    return MD.assemble(rows.withColumn(key, F.monotonically_increasing_id()), _MEANFILL_FEATS, key=key)


def _hex(key: str) -> str:
    return f"substr(md5({key}), 1, 8)"


def _training_sql() -> str:
    """Training rows of the smaller class (label 1) in the mean-filled call frame, and the rows missing."""
    filled, select = _mean_filled_sql().rsplit("\nSELECT ", 1)
    return f"""{filled},
frame AS (SELECT {select}),
sided AS (SELECT *, {_hex("'42|' || CAST(contact_id AS VARCHAR)")} AS h FROM frame),
train AS (SELECT * FROM sided QUALIFY row_number() OVER (PARTITION BY label ORDER BY h, contact_id)
            > round(0.2 * count(*) OVER (PARTITION BY label))),
small AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY h, contact_id) AS place FROM train WHERE label = 1),
need AS (SELECT count(*) FILTER (WHERE label = 0) - count(*) FILTER (WHERE label = 1) AS need,
                count(*) FILTER (WHERE label = 1) AS n FROM train),
near AS MATERIALIZED (
  SELECT a.contact_id, b.contact_id AS neighbour, {_gap()} AS gap FROM small a CROSS JOIN small b
  WHERE a.contact_id <> b.contact_id
  QUALIFY row_number() OVER (PARTITION BY a.contact_id ORDER BY {_gap()}, b.contact_id) <= {OS.NEIGHBOURS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY gap, neighbour) AS rank FROM near)"""


def _gap() -> str:
    return " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _MEANFILL_FEATS)


@register("minority_neighbours", _training_sql() + f"""
SELECT contact_id, CAST(rank AS INTEGER) AS rank, neighbour, {x6('sqrt(gap)')} AS distance FROM ranked""")
def q_minority_neighbours(spark, d):
    """JN-5: the five nearest minority training calls of every minority training call, exact."""
    train = training_calls(spark, d).where("NOT is_test AND label = 1")
    return r6(NB.knn_join(train, _MEANFILL_FEATS, OS.NEIGHBOURS, "contact_id"))


_DRAW = "'42|' || CAST(contact_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR) || "


@register("minority_oversampled", _training_sql() + f""",
copies AS (SELECT contact_id, unnest(range(1, CAST(need // n + CASE WHEN place <= need % n THEN 1 ELSE 0 END AS BIGINT) + 1))
             AS copy FROM small CROSS JOIN need),
drawn AS (SELECT contact_id, copy,
                 CAST('0x' || {_hex(_DRAW + "'|neighbour'")} AS UBIGINT) % {OS.NEIGHBOURS} + 1 AS rank,
                 CAST(CAST('0x' || {_hex(_DRAW + "'|gap'")} AS UBIGINT) AS DOUBLE) / 4294967296.0 AS gap FROM copies)
SELECT d.contact_id AS base, d.copy, r.neighbour, {x6('d.gap')} AS gap,
       {", ".join(f"{x6(f'x.{c} + d.gap * (y.{c} - x.{c})')} AS {c}" for c in _MEANFILL_FEATS)}, 1 AS label
FROM drawn d JOIN ranked r ON d.contact_id = r.contact_id AND d.rank = r.rank
JOIN small x ON d.contact_id = x.contact_id JOIN small y ON r.neighbour = y.contact_id""")
def q_minority_oversampled(spark, d):
    """ML-11: the synthetic minority rows that bring the training classes to parity."""
    train = training_calls(spark, d).where("NOT is_test")
    return r6(OS.synthetic_rows(train, _MEANFILL_FEATS, "contact_id"))


@register("oversampled_forest")
def q_oversampled_forest(spark, d):
    """ML-11: forest on the oversampled training calls, exact AUC on the untouched test calls."""
    with passing(spark):
        with passing(spark):
            calls = training_calls(spark, d)
            test = stored(MD.assemble(calls.where("is_test"), _MEANFILL_FEATS, key="contact_id"), "test-calls", keep=True)
            frame = parity_frame(calls.where("NOT is_test"))
        sizes = frame.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()   # two classes
        model = MD.forest(100).fit(frame)   # reads the rows a few times, so that no copy of them is kept beside its own
        auc = auc_from_scores(MD.p_default(model.transform(test)), "label", "p_default").first()["auc"]
    return r6(spark.createDataFrame([(int(r["label"]), r["n"], auc) for r in sizes], "label int, n long, test_auc double"))


@register("small_grid_search")
def q_small_grid_search(spark, d):
    """ML-7 with the original's grid for small tables: mean and per-fold exact AUC of every point over five
    balanced folds of the oversampled training calls, and the best point."""
    with passing(spark):
        calls = training_calls(spark, d).where("NOT is_test")

        def rebalanced(rows):
            with passing(spark):
                whole = growing(calls).join(rows.select("contact_id"), "contact_id", "left_semi")
                return parity_frame(stored(whole, "fold-calls"))

        found = SE.search(MD.assemble(calls, _MEANFILL_FEATS, key="contact_id"), MD.boosted(), MD.SMALL_GRID, 5,
                          "contact_id", 10, rebalanced)
    best = SE.best_point(found)
    rows = [(p["maxIter"], p["maxDepth"], p["stepSize"], mean, per, p == best) for p, mean, per in found]
    out = spark.createDataFrame(rows, "rounds int, depth int, learning_rate double, mean_auc double, "
                                      "fold_aucs array<double>, best boolean")
    return r6(out.withColumn("fold_aucs", F.transform("fold_aucs", lambda x: F.round(x, 6))))


def _tree_explained(spark, d):
    frame, feats = model_frame(spark, d)
    ensemble = TR.Ensemble.of(boosted_model(spark, d), spark)
    return TR.attributions(frame.where("is_test"), ensemble, feats, [S.ID_COL]), feats


@register("tree_attributions")
def q_tree_attributions(spark, d):
    """EXP-1 (boosted trees): base value, the contribution of every feature and the raw score of every test
    customer; base value + contributions = raw score."""
    return r6(_tree_explained(spark, d)[0])


@register("tree_reasons")
def q_tree_reasons(spark, d):
    """EXP-1 -> EXP-3 / EXP-4: each test customer's three strongest reasons by the model's own attributions."""
    explained, feats = _tree_explained(spark, d)
    contribs = X.contributions_array(feats, "c_")
    return explained.select(F.col(S.ID_COL).alias("customer_id"), X.top_reasons(contribs).alias("top_risk_factors"),
                            X.top_reasons_signed(contribs).alias("legacy_top_features"))
