"""Joins, fits and aggregates whose cost on the driver or in one task must not grow with the input."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from callrisk import session
from callrisk.operators import models as MD
from callrisk.operators import neighbours as NB
from callrisk.operators import oversample as OS
from callrisk.operators import profile as P
from callrisk.operators import search as SE

FEATS = ["x", "y"]


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(0, 600).select(i.alias("record_no"), ((i * 7919) % 1000 / 1000.0).alias("x"),
                                      ((i * 104729) % 97).cast("double").alias("y"),
                                      (i % 3 == 0).cast("int").alias("label"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def both(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_split_of_many_rows_is_not_broadcast(spark, rows, monkeypatch):
    frame = session.stored(MD.assemble(rows, FEATS), "frame")
    small = MD.with_split(frame)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 100)
    large, folds = MD.with_split(frame), SE.balanced_folds(frame, 5, "record_no")
    for df in (large, folds):
        top = plan(df).split("Join", 1)[0]
        assert top.rstrip().endswith("SortMerge"), plan(df)
    assert both(small, small.columns) == both(large, small.columns) and large.count() == 600
    assert sorted(r["count"] for r in folds.groupBy("held_out").count().collect()) == [120] * 5


def test_synthetic_rows_of_a_large_class_are_not_broadcast(spark, rows, monkeypatch):
    few = OS.synthetic_rows(rows, FEATS, "record_no")
    monkeypatch.setattr(session, "BROADCAST_ROWS", 100)
    many = OS.synthetic_rows(rows, FEATS, "record_no")
    assert plan(many).count("SortMergeJoin") >= 3
    assert both(few, few.columns) == both(many, few.columns) and many.count() == 200


def test_training_rows_are_dealt_over_bounded_tasks(spark, rows, monkeypatch):
    frame = MD.assemble(rows, FEATS).coalesce(1)
    assert SE.dealt(frame) is frame
    monkeypatch.setattr(SE, "TASK_ROWS", 100)
    parts = SE.dealt(frame)
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) <= 110
    assert both(parts, ["record_no", "label"]) == both(frame, ["record_no", "label"])
    seen = []

    class Estimator:
        def fit(self, train):
            seen.append(train.rdd.getNumPartitions())

    MD.fit_persisted(Estimator(), frame)
    assert seen == [6]


def test_correlation_aggregates_stay_compiled(spark, monkeypatch):
    cols = [f"c{j}" for j in range(8)]
    i = F.col("id")
    df = spark.range(0, 300).select(*[F.when(i % (j + 7) != 0, (i * (7919 + 13 * j)) % 101 + i * j).alias(c)
                                      for j, c in enumerate(cols)])
    out = P.correlation_long(df, cols)
    assert plan(out).count("corr(") and " HashAggregate" in plan(out)
    most = max(line.count("corr(") for line in plan(out).splitlines())
    assert most <= P.PAIRS and P.PAIRS * 6 <= int(spark.conf.get("spark.sql.codegen.maxFields"))
    got = {(r["a"], r["b"]): r["corr"] for r in out.collect()}
    data = [tuple(np.nan if v is None else float(v) for v in r) for r in df.collect()]
    x = np.array(data)
    assert len(got) == 28
    for (a, b), value in got.items():
        u, v = x[:, cols.index(a)], x[:, cols.index(b)]
        ok = ~np.isnan(u) & ~np.isnan(v)
        assert abs(value - np.corrcoef(u[ok], v[ok])[0, 1]) < 1e-9


def test_neighbour_joins_side_by_side_leave_the_session_as_it_was(spark, rows):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    parts = [rows.where(F.col("record_no") % 2 == k) for k in range(2)]
    alone = [both(NB.knn_join(p, FEATS, 3, "record_no"), ["record_no", "rank", "neighbour"]) for p in parts]
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda p: NB.knn_join(p, FEATS, 3, "record_no"), parts))
    assert spark.conf.get(name) == before
    assert [both(df, ["record_no", "rank", "neighbour"]) for df in found] == alone


def test_calls_are_aggregated_once_for_the_means_and_the_filled_rows(spark):
    """The means are read from written calls, so that the lines are not shuffled a second time to fill them."""
    from callrisk.plans.prepare import q_mean_filled_features
    out = q_mean_filled_features(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in plan(out) and "Exchange" not in plan(out) and out.count() > 0
