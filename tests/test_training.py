"""Oversampling, prefix-sharing grid search and tree attributions against plain computations."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from callrisk.functions.ranking import auc_from_scores
from callrisk.operators import models as MD
from callrisk.operators import oversample as OS
from callrisk.operators import search as SE
from callrisk.operators import trees as TR

FEATS = ["x", "y", "z", "w"]


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    df = spark.range(0, 900).select(
        i.alias("record_no"), ((i * 7919) % 1000 / 1000.0).alias("x"), ((i * 104729) % 97).cast("double").alias("y"),
        ((i * 31) % 7).cast("double").alias("z"), ((i * 17) % 13).cast("double").alias("w"))
    signal = F.col("x") + F.col("z") / 10 + (F.col("y") % 5) / 10 - F.when(F.col("w") > 6, 0.3).otherwise(0.0)
    return df.withColumn("label", (signal > 0.9).cast("int")).cache()


@pytest.fixture(scope="module")
def frame(rows):
    return MD.assemble(rows, FEATS).repartition(3).cache()


# -- oversampling -----------------------------------------------------------------------------

def test_synthetic_rows_lie_between_neighbours(spark, rows):
    few = rows.where("label = 0 OR record_no % 3 = 0")
    made = [r.asDict() for r in OS.synthetic_rows(few, FEATS, "record_no").collect()]
    sizes = {r["label"]: r["count"] for r in few.groupBy("label").count().collect()}
    small = min(sizes, key=sizes.get)
    assert len(made) == max(sizes.values()) - min(sizes.values()) and {m["label"] for m in made} == {small}
    known = {r.record_no: np.array([r[f] for f in FEATS]) for r in few.where(F.col("label") == small).collect()}
    copies = {}
    for m in made:
        copies[m["base"]] = copies.get(m["base"], 0) + 1
        x, y = known[m["base"]], known[m["neighbour"]]
        gaps = sorted((float(((x - v) ** 2).sum()), i) for i, v in known.items() if i != m["base"])[:OS.NEIGHBOURS]
        assert m["neighbour"] in {i for _, i in gaps} and 0 <= m["gap"] < 1
        assert np.allclose([m[f] for f in FEATS], x + m["gap"] * (y - x), atol=1e-9)
    assert max(copies.values()) - min(copies.values()) <= 1
    both = OS.oversampled(few, FEATS, "record_no").groupBy("label").count().collect()
    assert len({r["count"] for r in both}) == 1
    again = [r.asDict() for r in OS.synthetic_rows(few.repartition(9), FEATS, "record_no").collect()]
    assert sorted(map(str, again)) == sorted(map(str, made))


def test_oversampling_defined_cases(spark, rows):
    few = rows.where("label = 0").limit(50).unionByName(rows.where("label = 1").limit(9))
    assert OS.synthetic_rows(few, FEATS, "record_no").count() == 0          # fewer than ten rows of a class
    assert OS.synthetic_rows(rows.where("label = 1"), FEATS, "record_no").count() == 0
    assert OS.synthetic_rows(rows.limit(0), FEATS, "record_no").count() == 0
    odd = rows.where("label = 0").unionByName(rows.where("label = 1").limit(30)) \
        .withColumn("x", F.when(F.col("record_no") % 50 == 0, F.lit(None)).otherwise(F.col("x")))
    made = OS.synthetic_rows(odd, FEATS, "record_no")
    assert made.where("x IS NULL").count() == 0 and made.count() > 0


# -- grid search ------------------------------------------------------------------------------

def test_folds_are_balanced(frame):
    for folds in (3, 5):
        dealt = SE.balanced_folds(frame, folds).groupBy("label", "held_out").count().collect()
        assert len(dealt) == 2 * folds
        for y in (0.0, 1.0):
            sizes = [r["count"] for r in dealt if r["label"] == y]
            assert max(sizes) - min(sizes) <= 1


def test_prefixes_equal_separate_fits(spark, frame):
    """The search finds what a fit for every point and fold finds (row sampling off: it depends on partitions)."""
    grid = {"maxIter": [2, 5, 8], "maxDepth": [2, 4], "subsamplingRate": [1.0]}
    estimator = MD.boosted(featureSubsetStrategy="0.8")
    found = SE.search(frame, estimator, grid, folds=3)
    assert [p for p, _, _ in found] == SE.points(grid) and len(found) == 6
    dealt = SE.balanced_folds(frame, 3).cache()
    want = []
    for p in SE.points(grid):
        per = []
        for k in range(3):
            model = estimator.copy({estimator.getParam(n): v for n, v in p.items()}).fit(dealt.where(F.col("held_out") != k))
            scored = model.transform(dealt.where(F.col("held_out") == k)).withColumn("s", vector_to_array("rawPrediction")[1])
            per.append(auc_from_scores(scored, "label", "s").first()["auc"])
        want.append((p, sum(per) / 3, per))
    for (_, mean, per), (_, wmean, wper) in zip(found, want):
        assert abs(mean - wmean) < 1e-12 and np.allclose(per, wper, atol=1e-12)
    assert SE.best_point(found) == SE.best_point(want)


def test_search_fits_once_for_all_rounds(frame, monkeypatch):
    fits = []
    real = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, *a: fits.append(1) or real(self, *a))
    SE.search(frame, MD.boosted(), {"maxIter": [1, 2, 3], "maxDepth": [1, 2]}, folds=2)
    assert len(fits) == 4
    assert len({SE._group(p) for p in SE.points(MD.TRAINING_GRID)}) == 27
    assert len({SE._group(p) for p in SE.points(MD.FULL_GRID)}) == 72


def test_prepare_sees_training_rows_alone(frame):
    seen = []

    def prepare(rows):
        seen.append({r.record_no for r in rows.select("record_no").collect()})
        return rows.where("label = 1").unionByName(rows)

    SE.search(frame, MD.boosted(), {"maxIter": [1]}, folds=3, prepare=prepare)
    everything = {r.record_no for r in frame.select("record_no").collect()}
    assert len(seen) == 3 and all(abs(len(s) - len(everything) * 2 / 3) <= 2 for s in seen)
    assert set.union(*seen) == everything


# -- attributions -----------------------------------------------------------------------------

def expectation(tree, x, known, node=0):
    """Path-dependent expectation of one tree with the features ``known`` given."""
    if tree["left"][node] < 0:
        return tree["value"][node]
    f = tree["feature"][node]
    sides = (tree["left"][node], tree["right"][node])
    if f in known:
        return expectation(tree, x, known, sides[0] if x[f] <= tree["threshold"][node] else sides[1])
    return sum(tree["rows"][s] / tree["rows"][node] * expectation(tree, x, known, s) for s in sides)


def brute_force(ensemble, x):
    m = len(x)
    value = {s: sum(expectation(t, x, s) for t in ensemble.trees)
             for n in range(m + 1) for s in map(frozenset, combinations(range(m), n))}
    out = np.zeros(m)
    for i in range(m):
        for s, v in value.items():
            if i not in s:
                out[i] += factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (value[s | {i}] - v)
    return value[frozenset()], out


@pytest.fixture(scope="module", params=["boosted", "forest", "single leaf"])
def fitted(request, frame):
    if request.param == "boosted":
        return GBTClassifier(maxIter=6, maxDepth=4, seed=3, subsamplingRate=0.8).fit(frame)
    if request.param == "forest":
        return RandomForestClassifier(numTrees=7, maxDepth=4, seed=3).fit(frame)
    return GBTClassifier(maxIter=2, maxDepth=0, seed=3).fit(frame)


@pytest.mark.parametrize("table", [0, 8])
def test_attributions_equal_all_feature_subsets(spark, frame, fitted, table, monkeypatch):
    """With and without the tables of patterns; base + contributions = the model's own raw score."""
    monkeypatch.setattr(TR, "TABLE_FEATURES", table)
    ensemble = TR.Ensemble.of(fitted, spark)
    scored = fitted.transform(frame)
    forest = isinstance(fitted, MD.RandomForestClassifier().__class__) or "RandomForest" in type(fitted).__name__
    raw = vector_to_array("probability" if forest else "rawPrediction")[1].alias("raw")
    own = {r.record_no: (r.raw, np.array(r.v)) for r in scored.select("record_no", raw, vector_to_array("features").alias("v")).collect()}
    for r in TR.attributions(frame, ensemble, FEATS, ["record_no", "label"]).collect():
        parts = np.array([r[f"c_{f}"] for f in FEATS])
        assert abs(r.base_value + parts.sum() - r.raw_score) < 1e-9
        assert abs(r.raw_score - own[r.record_no][0]) < 1e-9
        if r.record_no < 25:
            base, want = brute_force(ensemble, own[r.record_no][1])
            assert abs(base - r.base_value) < 1e-9 and np.allclose(parts, want, atol=1e-9)


def test_prefix_margins(spark, frame):
    """A fit of fewer rounds is the beginning of a longer one, also with rows and columns sampled."""
    sampled = {"maxDepth": 3, "seed": 3, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.5"}
    model = GBTClassifier(maxIter=5, **sampled).fit(frame)
    short = GBTClassifier(maxIter=2, **sampled).fit(frame)
    ensemble = TR.Ensemble.of(model, spark)
    got = {r.record_no: r.margins for r in TR.prefix_margins(frame, ensemble, [2, 5], ["record_no"]).collect()}
    for j, m in enumerate((short, model)):
        for r in m.transform(frame).select("record_no", vector_to_array("rawPrediction")[1].alias("s")).collect():
            assert abs(got[r.record_no][j] - r.s) < 1e-9


def test_deep_trees(spark, frame):
    model = GBTClassifier(maxIter=2, maxDepth=9, minInstancesPerNode=1, seed=1).fit(frame)
    for r in TR.attributions(frame, TR.Ensemble.of(model, spark), FEATS, ["record_no"]).collect():
        assert abs(r.base_value + sum(r[f"c_{f}"] for f in FEATS) - r.raw_score) < 1e-9
