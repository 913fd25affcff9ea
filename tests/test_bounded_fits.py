"""What fits and their preparation keep: no node numbers, a bounded number of fits, no folder that nothing reads."""

import os
import threading
import time

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from callrisk import session as SS
from callrisk.operators import models as MD
from callrisk.operators import oversample as OS
from callrisk.operators import search as SE


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    df = spark.range(0, 600).select(i.alias("record_no"), ((i * 7919) % 1000 / 1000.0).alias("x"),
                                    ((i * 104729) % 97).cast("double").alias("y"), (i % 5).cast("int").alias("fold"))
    return df.withColumn("label", (F.col("x") + F.col("y") / 97 > 1.3).cast("int")).cache()


@pytest.fixture(scope="module")
def frame(rows):
    return MD.assemble(rows, ["x", "y"]).join(rows.select("record_no", "fold"), "record_no").coalesce(1).cache()


def folders(spark):
    return set(os.listdir(SS.ensure_checkpoint_dir(spark).removeprefix("file:")))


@pytest.fixture()
def together(monkeypatch):
    """The greatest number of fits that ran at once."""
    running, most, lock, real = [], [0], threading.Lock(), GBTClassifier.fit

    def fit(self, *a):
        with lock:
            running.append(1)
            most[0] = max(most[0], len(running))
        time.sleep(0.2)
        try:
            return real(self, *a)
        finally:
            with lock:
                running.pop()

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    return most


def test_fits_keep_no_node_numbers(frame):
    """the same trees with and without."""
    assert not MD.boosted().getCacheNodeIds() and not MD.forest().getCacheNodeIds()
    for estimator in (MD.boosted(maxIter=4), MD.forest(7)):
        plain, kept = (estimator.copy({estimator.cacheNodeIds: x}).fit(frame).toDebugString for x in (False, True))
        assert plain.split("\n")[1:] == kept.split("\n")[1:]


def test_folds_of_many_tasks_are_fitted_one_at_a_time(frame, together, monkeypatch):
    """small folds still run side by side."""
    want = MD.cross_validated_auc(frame, MD.boosted(maxIter=2, subsamplingRate=1.0, featureSubsetStrategy="all"))
    assert together[0] > 1
    together[0] = 0
    monkeypatch.setattr(SE, "TASK_ROWS", 600 // (3 * frame.sparkSession.sparkContext.defaultParallelism) or 1)
    got = MD.cross_validated_auc(frame, MD.boosted(maxIter=2, subsamplingRate=1.0, featureSubsetStrategy="all"))
    assert together[0] == 1 and got == pytest.approx(want, abs=1e-9)


def test_search_lets_a_fold_go_before_the_next(frame, together, monkeypatch):
    """where the rows of a fold are many tasks, they are prepared, fitted for every point, and released."""
    monkeypatch.setattr(SE, "TASK_ROWS", 600 // (3 * frame.sparkSession.sparkContext.defaultParallelism) or 1)
    seen = []

    def prepare(part):
        seen.append(len(frame.sparkSession.sparkContext._jsc.getPersistentRDDs()))
        return SS.stored(part, "prepared")

    before = {x for x in folders(frame.sparkSession) if x.startswith("prepared")}
    found = SE.search(frame.drop("fold"), MD.boosted(), {"maxIter": [1, 2], "maxDepth": [1, 2]}, folds=3, prepare=prepare)
    assert len(found) == 4 and all(len(per) == 3 for _, _, per in found) and together[0] == 1
    assert len(seen) == 3 and max(seen) == min(seen)
    assert {x for x in folders(frame.sparkSession) if x.startswith("prepared")} == before


def test_passing_deletes_what_nothing_reads(spark, rows):
    """neighbours, links and shuffles of the synthetic rows go once the rows are written."""
    few = SS.stored(rows.where("label = 0").unionByName(rows.where("label = 1").limit(40)), "few-calls")
    known = folders(spark)
    was = spark.conf.get(SS._CLEANUP)
    with SS.passing(spark):
        with SS.passing(spark):
            out = SS.stored(OS.oversampled(few, ["x", "y"], "record_no"), "parity", keep=True)
        assert {x.split("-")[0] for x in folders(spark) - known} == {"parity"}
        assert len({r["count"] for r in out.groupBy("label").count().collect()}) == 1
        assert spark.conf.get(SS._CLEANUP) == "true"
    assert folders(spark) == known and spark.conf.get(SS._CLEANUP) == was
    assert OS.oversampled(few, ["x", "y"], "record_no").count() > few.count()   # outside, the plan stays readable


def test_passing_removes_shuffle_files(spark, rows):
    def files():
        at = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {at.apply(i).getName() for i in range(at.size()) if at.apply(i).getName().startswith("shuffle_")}

    before = files()
    with SS.passing(spark):
        SS.stored(rows.repartition(3, "record_no"), "dealt")
        for _ in range(50):
            if not files() - before:
                break
            time.sleep(0.1)
        assert not files() - before


def test_stored_rows_come_in_tasks(spark, rows):
    zone = spark.conf.get("spark.sql.session.timeZone")
    out = SS.stored(rows.coalesce(1), "in-tasks", task_rows=100)
    per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 600 and max(per) <= 200 and len(per) >= 3
    assert out.sparkSession.conf.get("spark.sql.session.timeZone") == zone
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
