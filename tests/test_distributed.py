"""Skew-safe distributed helpers agree with the single-task window forms,
also when one key holds most of the rows; split / upsert conservation;
explanation additivity."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from callrisk.functions.ranking import next_in_order, rank_within, running_count
from callrisk.operators import explain as X
from callrisk.operators import metrics as M
from callrisk.sinks import writers as W


@pytest.fixture()
def skewed(spark):
    # key 0 holds ~2/3 of the rows; order ties broken by id
    return spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(0)).alias("k"),
        (F.col("id") * 7919 % 1000).alias("t"), F.col("id").alias("id"))


def test_rank_within_matches_row_number(spark, skewed):
    got = rank_within(skewed, ["k"], [F.col("t").desc(), F.col("id")], out="r", total="n", partitions=16)
    w = Window.partitionBy("k").orderBy(F.col("t").desc(), F.col("id"))
    ref = skewed.select("id", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n"))
    assert got.select("id", "r", "n").exceptAll(ref).count() == 0
    assert got.count() == 3000


def test_running_count_global_and_keyed(spark, skewed):
    one = skewed.withColumn("w", F.lit(1))
    ranked, totals = running_count(one, [], ["t", "id"], "w", partitions=8)
    assert sorted(r["_cum"] for r in ranked.collect()) == list(range(1, 3001))
    assert totals.first()["_total"] == 3000


def test_next_in_order_matches_lead(spark, skewed):
    got = next_in_order(skewed, ["k"], ["t", "id"], ["t"], partitions=16)
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = skewed.select("k", "t", "id", F.lead("t").over(w).alias("next_t"))
    assert got.select("k", "t", "id", "next_t").exceptAll(ref).count() == 0


def test_split_conserves_rows_and_exact_share(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("record_no"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    s = M.split_columns(df, "record_no")
    assert s.count() == 1000
    per = {r["label"]: r["n"] for r in s.filter("is_test_exact").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per == {0: 150, 1: 50}
    assert {r["fold"] for r in s.select("fold").distinct().collect()} == {0, 1, 2, 3, 4}


def test_upsert_latest_wins(spark):
    cur = spark.createDataFrame([(1, None, "2024-01-01"), (2, None, "2024-01-01")],
                                "customer_id long, risk_score double, risk_updated_at string") \
        .withColumn("risk_updated_at", F.col("risk_updated_at").cast("timestamp"))
    upd = spark.createDataFrame([(1, 50.0, "2024-01-02"), (1, 70.0, "2024-01-03")],
                                "customer_id long, risk_score double, risk_updated_at string") \
        .withColumn("risk_updated_at", F.col("risk_updated_at").cast("timestamp"))
    out = {r["customer_id"]: r["risk_score"] for r in W.crm_upsert(cur, upd).collect()}
    assert out == {1: 70.0, 2: None}


def test_upsert_of_never_scored_and_equal_times(spark):
    """Null times keep the stored row's columns; equal times go by event id however the rows are partitioned."""
    kind = "customer_id long, risk_score double, name string, risk_updated_at timestamp, event_id long"
    cur = spark.createDataFrame([(1, None, "a", None), (2, None, "b", None)], kind.rsplit(",", 1)[0])
    upd = spark.createDataFrame([(1, 7.0, "x", None, 5), (1, 9.0, "y", None, 6)], kind) \
        .withColumn("risk_updated_at", F.lit("2024-01-03").cast("timestamp"))
    for n in (1, 8):
        out = {r["customer_id"]: (r["risk_score"], r["name"]) for r in
               W.crm_upsert(cur.repartition(n), upd.repartition(n, "event_id")).collect()}
        assert out == {1: (9.0, "y"), 2: (None, "b")}
    assert "event_id" not in W.crm_upsert(cur, upd).columns


def test_rule_attribution_is_additive(spark):
    rows = [(s, b, n) for s in (-0.9, -0.2, 0.3) for b in (100.0, 20000.0, 40000.0) for n in (0, 2, 5)]
    df = spark.createDataFrame(rows, "customer_sentiment double, account_balance double, n_risk_factors int")
    df = df.withColumn("risk_factors", F.expr("array_repeat('f', n_risk_factors)"))
    from callrisk.operators.rules import rule_score
    out = X.rule_contributions(df.withColumn("score", rule_score())).collect()
    for r in out:
        total = r["base_value"] + r["c_customer_sentiment"] + r["c_account_balance"] + r["c_risk_factors"] \
            + r["clamp_adjustment"]
        assert total == pytest.approx(r["score"])


def test_top_reasons_order_and_text(spark):
    df = spark.createDataFrame([(1, 10.0, -15.0, 5.0)], "id int, c_a double, c_b double, c_c double")
    arr = X.contributions_array(["a", "b", "c"])
    r = df.select(X.top_reasons(arr, 2).alias("t"), X.top_reasons_signed(arr, 2).alias("s")).first()
    assert r["t"] == "b (decreases risk), a (increases risk)"
    assert r["s"] == "a, c"


def test_linear_attributions_add_up_to_logit(spark):
    from callrisk.operators import models as MD
    df = spark.range(0, 300).select(
        F.col("id").alias("record_no"), (F.col("id") % 7).cast("double").alias("a"),
        ((F.col("id") * 13) % 11).cast("double").alias("b"),
        ((F.col("id") % 7 + (F.col("id") * 13) % 11) > 8).cast("int").alias("label"))
    frame = MD.assemble(df, ["a", "b"])
    out, _ = MD.linear_attributions(frame, ["a", "b"])
    for r in out.collect():
        assert r["base_value"] + r["c_a"] + r["c_b"] == pytest.approx(r["logit"], abs=1e-6)


def test_weighted_recall_equals_accuracy(spark):
    df = spark.range(0, 500).select(((F.col("id") * 7) % 3 == 0).cast("int").alias("label"),
                                    ((F.col("id") * 5) % 4 == 0).cast("int").alias("pred"))
    rep = {r["class"]: r for r in M.classification_report(df).collect()}
    assert rep["weighted avg"]["recall"] == pytest.approx(rep["accuracy"]["f1"])
    conf = {(r["label"], r["pred"]): r["n"] for r in M.confusion(df).collect()}
    assert sum(conf.values()) == 500 and len(conf) == 4
