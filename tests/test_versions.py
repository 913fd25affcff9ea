"""Commit log, keyed upserts, replays and failures between write and commit."""

import os

import pytest
from pyspark.sql import functions as F

from callrisk.operators import sessions as SE
from callrisk.plans import flows as FL
from callrisk.sinks import versions as V
from callrisk.sinks import writers as W
from callrisk.sources import adapters as AD

from conftest import SF_SMALL

KIND = "customer_id long, risk_score double, risk_updated_at timestamp"


def rows(spark, *values):
    return spark.createDataFrame(list(values), "customer_id long, risk_score double, ts string") \
        .withColumn("risk_updated_at", F.col("ts").cast("timestamp")).drop("ts")


def as_dict(df):
    return {r["customer_id"]: r["risk_score"] for r in df.collect()}


@pytest.fixture
def table(spark, scratch):
    from pyspark.sql.types import _parse_datatype_string
    return V.KeyedTable(spark, os.path.join(scratch, "crm"), _parse_datatype_string(KIND), buckets=4)


def test_commit_log_is_exclusive_and_ordered(spark, scratch):
    log = V.CommitLog(spark, os.path.join(scratch, "log"))
    assert log.latest() == (-1, None)
    for n in range(12):
        log.commit(n, {"n": n})
    assert log.latest() == (11, {"n": 11}) and log.numbers() == list(range(12))
    with pytest.raises(Exception, match="xist"):
        log.commit(11, {"n": "other"})
    assert log.latest() == (11, {"n": 11})


def test_upserts_replays_and_late_rows(spark, table):
    assert table.read().count() == 0
    assert table.upsert(rows(spark, (1, 10.0, "2024-01-01"), (2, 20.0, "2024-01-01"), (None, 1.0, "2024-01-01")), 0)
    assert table.upsert(rows(spark, (2, 25.0, "2024-01-02"), (3, 30.0, "2024-01-02"), (1, 5.0, "2023-01-01")), 1)
    want = {1: 10.0, 2: 25.0, 3: 30.0}                       # the older row of customer 1 lost
    assert as_dict(table.read()) == want
    assert not table.upsert(rows(spark, (9, 99.0, "2025-01-01")), 1)                 # a replayed batch
    assert not table.upsert(rows(spark, (9, 99.0, "2025-01-01")), 0)
    assert as_dict(table.read()) == want
    assert table.upsert(rows(spark, (9, 99.0, "2025-01-01")), 0, source="other")     # another source counts for itself
    assert table.upsert(rows(spark), 2) and as_dict(table.read()) == {**want, 9: 99.0}
    with pytest.raises(ValueError):
        V.KeyedTable(spark, table.folder, table.schema, buckets=5).upsert(rows(spark), 3)


def test_only_touched_buckets_are_rewritten(spark, table):
    table.upsert(spark.range(100).select(F.col("id").alias("customer_id"), F.lit(1.0).alias("risk_score"),
                                         F.lit("2024-01-01").cast("timestamp").alias("risk_updated_at")), 0)
    before = table.log.latest()[1]["folders"]
    table.upsert(rows(spark, (5, 2.0, "2024-02-01")), 1)
    after = table.log.latest()[1]["folders"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 100 and as_dict(table.read())[5] == 2.0


def test_failure_between_write_and_commit_leaves_the_old_version(spark, table, monkeypatch):
    table.upsert(rows(spark, (1, 10.0, "2024-01-01")), 0)
    real = V.CommitLog.commit
    monkeypatch.setattr(V.CommitLog, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.upsert(rows(spark, (1, 50.0, "2024-03-01")), 1)
    monkeypatch.setattr(V.CommitLog, "commit", real)
    assert as_dict(table.read()) == {1: 10.0}
    assert table.upsert(rows(spark, (1, 50.0, "2024-03-01")), 1)                     # the retry
    assert as_dict(table.read()) == {1: 50.0}


def test_a_reader_keeps_its_version(spark, table):
    table.upsert(rows(spark, (1, 10.0, "2024-01-01")), 0)
    old = table.read()
    table.upsert(rows(spark, (1, 50.0, "2024-03-01")), 1)
    assert as_dict(old) == {1: 10.0} and as_dict(table.read()) == {1: 50.0}


def test_live_scores_reach_the_crm(spark, scratch):
    """The written table equals the batch upsert of the same scores, also when the stream starts again."""
    snaps = AD.snapshots(spark, SF_SMALL)
    crm = AD.crm(spark, SF_SMALL)
    src = os.path.join(scratch, "ev")
    snaps.write.parquet(src)
    last = snaps.agg(F.max("ts")).first()[0]
    current = crm.select("customer_id", F.lit(None).cast("double").alias("risk_score"), F.lit(None).cast("string").alias("risk_level"),
                         F.lit(None).cast("timestamp").alias("risk_updated_at"), F.lit("").alias("risk_factors_text"),
                         F.lit("").alias("recommendations_text"))
    table = V.KeyedTable(spark, os.path.join(scratch, "crm"), current.schema, buckets=8)
    table.upsert(current, 0)
    stream = spark.readStream.schema(snaps.schema).parquet(src)
    for ck in ("ck", "ck"):                                   # the second start has nothing new
        FL.start_crm_updates(stream, crm, table, os.path.join(scratch, ck)).awaitTermination(300)
    got = {r["customer_id"]: r["risk_score"] for r in table.read().collect()}
    assert len(got) == crm.select("customer_id").distinct().count() == table.read().count()
    scored = SE.scored_events(SE.classify_events(snaps), crm).where(F.col("ts") <= F.lit(last) - F.expr("INTERVAL 1 HOUR"))
    want = {r["call_id"]: r["s"] for r in scored.groupBy("call_id").agg(
        F.max_by("risk_score", F.struct("ts", "event_id")).alias("s")).collect()}
    known = {i for i in want if i in got}
    assert known and all(got[i] == want[i] for i in known) and all(got[i] is None for i in got if i not in want)


def test_latest_model_is_switched_whole(spark, scratch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml import Pipeline
    df = spark.range(4).selectExpr("CAST(id AS DOUBLE) AS x")
    base = os.path.join(scratch, "models")
    for version in ("v1", "v2"):
        W.save_model(Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features")]).fit(df), base, "m", version, {})
        assert W.load_model(base, "m")[1]["version"] == version
    assert W.load_model(base, "m", "v1")[1]["version"] == "v1"
    with pytest.raises(FileNotFoundError):
        W.load_model(base, "none")
