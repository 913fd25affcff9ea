"""End-to-end runs on sf0.001 (PL-1, PL-4, PL-5, PL-6)."""

import os

from pyspark.sql import functions as F

from callrisk.plans import flows as FL
from callrisk.sources import adapters as AD
from conftest import SF_SMALL


def test_preparation_dispatch(spark):
    calls = FL.full_preparation(AD.calls(spark, SF_SMALL))
    prof = FL.full_preparation(AD.profile(spark, SF_SMALL))
    assert "customer_positivity_ratio" in calls.columns and "call_count" in calls.columns
    assert "debt_to_income" in prof.columns and "age_band" in prof.columns
    assert calls.filter(F.col("record_no").isNull()).count() == 0
    assert calls.select("record_no").distinct().count() == calls.count()


def test_complete_run_exports(spark, scratch):
    man = FL.complete_run(spark, AD.calls(spark, SF_SMALL), os.path.join(scratch, "out"), "t1",
                          params={"maxIter": 5, "maxDepth": 3})
    arts = {r["artefact"]: r["path"] for r in man.collect()}
    res = spark.read.parquet(os.path.join(scratch, "out", "risk_scores"))
    assert res.count() > 0
    assert res.filter((F.col("risk_score") < 0) | (F.col("risk_score") > 100)).count() == 0
    assert os.path.exists(os.path.join(scratch, "out", "models", "boosted", "latest"))
    summary = spark.read.json(arts["summary"]).first()
    assert summary["n_features"] > 0 and summary["mean_score"] is not None and summary["roc_auc"] is not None


def test_optimization_run_report(spark, scratch):
    rep = FL.optimization_run(spark, AD.calls(spark, SF_SMALL), grid={"maxDepth": [2, 3]}, params={"maxIter": 3},
                              folds=2, model_dir=os.path.join(scratch, "m")).first()
    assert os.path.exists(os.path.join(scratch, "m", "optimized", "latest"))
    assert len(rep["importances"]) == len(rep["selected_features"]) and rep["evaluation"]["confusion_0_0"] >= 0
    assert 0.0 <= rep["baseline_auc"] <= 1.0 and 0.0 <= rep["optimized_auc"] <= 1.0
    assert len(rep["selected_features"]) > 0


def test_live_scoring_stream(spark, scratch):
    snaps = AD.snapshots(spark, SF_SMALL)
    src = os.path.join(scratch, "ev")
    snaps.write.parquet(src)
    stream = spark.readStream.schema(snaps.schema).parquet(src)
    q = FL.start_live_scoring(stream, AD.crm(spark, SF_SMALL), os.path.join(scratch, "rooms"),
                              os.path.join(scratch, "ck"))
    q.awaitTermination(300)
    out = spark.read.parquet(os.path.join(scratch, "rooms"))
    assert out.count() > 0 and out.select("agent_id").distinct().count() > 1
