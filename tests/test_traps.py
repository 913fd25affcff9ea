"""Micro-table tests for the behaviours that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from callrisk import schema as S
from callrisk.functions import bands as B
from callrisk.functions.ranking import auc_from_scores, exact_medians, exact_modes, exact_quantiles
from callrisk.operators import aggregate as A
from callrisk.operators import clean as C
from callrisk.operators import features as FE
from callrisk.operators import profile as P
from callrisk.operators import rules as R


def test_band_edges(spark):
    vals = [39.99, 40.0, 59.99, 60.0, 69.99, 70.0, 70.01, 0.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["x"]: r for r in df.select(
        "x", B.band("x", B.BATCH_SAFETY).alias("batch"), B.band("x", B.REALTIME_DANGER).alias("rt"),
        B.band("x", B.MOBILE_DANGER).alias("mob"), B.band("x", B.ROUTING).alias("route")).collect()}
    assert got[70.0]["batch"] == "Low Risk" and got[69.99]["batch"] == "Medium Risk"
    assert got[40.0]["batch"] == "Medium Risk" and got[39.99]["batch"] == "High Risk"
    assert got[70.0]["rt"] == "高リスク" and got[39.99]["rt"] == "低リスク"          # T1: polarity flipped
    assert got[60.0]["mob"] == S.MOBILE_LABELS[0] and got[59.99]["mob"] == S.MOBILE_LABELS[1]
    assert got[70.0]["route"] == "MediumRiskFlow" and got[70.01]["route"] == "HighRiskFlow"   # strict
    assert got[40.0]["route"] == "LowRiskFlow"
    assert got[None]["batch"] is None


def test_right_closed_bins_and_zero_fill(spark):
    df = spark.createDataFrame([(a, c) for a, c in [(0.0, 550.0), (30.0, 550.01), (30.01, 850.0), (100.0, 851.0),
                                                    (101.0, None), (None, 300.0)]], "age double, credit_score double")
    out = C.zero_fill(FE.profile_features(df), ["age_band", "credit_band"]).collect()
    assert [r["age_band"] for r in out] == [0.0, 1.0, 2.0, 5.0, 0.0, 0.0]
    assert [r["credit_band"] for r in out] == [1.0, 2.0, 4.0, 0.0, 0.0, 1.0]


def test_exact_median_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert exact_medians(df, ["x"]) == {"x": 2.5}
    q = exact_quantiles(df, ["x"], {"q1": 0.25, "q3": 0.75}).first()
    assert q["q1"] == pytest.approx(1.75) and q["q3"] == pytest.approx(4.75)


def test_median_fill_approx_opt_in(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0), (5, None)], "record_no long, x double")
    exact = {r["record_no"]: r["x"] for r in C.median_fill(df).collect()}
    approx = {r["record_no"]: r["x"] for r in C.median_fill(df, approx_accuracy=10000).collect()}
    assert exact[5] == 2.5 and approx[5] == 2.0          # T6: the approximate form is not the pandas median


def test_median_fill_matches_pandas(spark):
    import pandas as pd
    rows = [(i, float(i % 7) if i % 5 else None) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "record_no long, x double")
    got = C.median_fill(df).orderBy("record_no").toPandas()["x"]
    ref = pd.Series([r[1] for r in rows])
    assert got.tolist() == ref.fillna(ref.median()).tolist()


def test_mode_smallest_on_tie_and_unknown(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)],
                               "s string, t string")
    out = C.mode_fill(df, ["s", "t"]).collect()
    assert [r["s"] for r in out] == ["b", "a", "b", "a", "a"]
    assert all(r["t"] == "Unknown" for r in out)
    m = {r["column"]: r["mode"] for r in exact_modes(df, ["s"]).collect()}
    assert m == {"s": "a"}


def test_rollup_drops_null_keys_and_sums_all_null_to_zero(spark):
    df = spark.createDataFrame([(1, "未払", None, 1.0, 2.0), (1, "支払済", None, 3.0, 4.0), (None, "未払", 5, 9.0, 9.0),
                                (2, "支払済", 3, None, 1.0)],
                               "record_no long, unpaid_flag string, agent_total_sentence long, "
                               "agent_sentence_ratio double, account_x double")
    out = {r["record_no"]: r for r in A.customer_rollup(df).collect()}
    assert set(out) == {1, 2}                                  # T8
    assert out[1]["agent_total_sentence"] == 0                 # T25
    assert out[1]["agent_sentence_ratio"] == 4.0               # T3: 'sentence' -> summed
    assert out[1]["account_x"] == 6.0                          # T3: 'account' contains 'count'
    assert out[1]["unpaid_flag"] == "支払済"                     # modal target, smallest on tie
    assert out[1]["call_count"] == 2


def test_feature_variants_and_zero_denominators(spark):
    df = spark.createDataFrame([(10.0, 0.0, 2, 0, 0, 0, 5.0, 0.0)],
                               "agent_talktime double, customer_talktime double, agent_positive_sentence long, "
                               "agent_negative_sentence long, agent_total_sentence long, customer_total_sentence long, "
                               "total_talktime double, total_conversation_duration double")
    a = FE.call_features_plus_one(df).first()
    b = FE.call_features_nonzero(df).first()
    assert a["agent_customer_talktime_ratio"] == 10.0 and b["agent_customer_talktime_ratio"] == 10000.0
    assert a["agent_positivity_ratio"] == pytest.approx(2 / 3)      # pos / (pos + neg + 1)
    assert b["agent_positivity_ratio"] == 2.0                        # pos / nz(total, 1)
    assert b["silence_ratio"] == -4.0 and a["silence_ratio"] == -4.0


def test_auc_ties_count_half(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "label int, p double")
    assert auc_from_scores(df, "label", "p").first()["auc"] == pytest.approx(0.625)
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", numBins=0)
    assert ev.evaluate(df.withColumn("label", F.col("label").cast("double"))) == pytest.approx(0.625)


def test_rule_score_floor_and_polarity(spark):
    rows = [(s, b, n) for s in (-0.9, -0.1, 0.0, 0.5, None) for b in (-10.0, 4999.0, 5000.0, 30001.0, None)
            for n in (0, 1, 4, 6)]
    df = spark.createDataFrame(rows, "customer_sentiment double, account_balance double, n int") \
        .withColumn("risk_factors", F.expr("array_repeat('f', n)"))
    out = df.select(R.rule_score().alias("s"), (R.rule_score() / 100.0).alias("p")).select(
        "s", (R.safety_score("p") + F.col("s")).alias("sum")).collect()
    assert min(r["s"] for r in out) >= 40.0 and max(r["s"] for r in out) <= 100.0     # T23
    assert all(r["sum"] == pytest.approx(100.0) for r in out)                          # T1


def test_histogram_nulls_and_flat(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double")
    h = P.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 0, 0, 0, 0]
    df2 = spark.createDataFrame([(0.0,), (10.0,), (5.0,), (None,)], "x double")
    h2 = P.histogram(df2, "x", 2).orderBy("bin").collect()
    assert [r["n"] for r in h2] == [1, 2]


def test_value_counts_and_filters(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 10.0)], "c string, x double")
    vc = {r["value"]: (r["n"], r["pct"]) for r in A.value_counts(df, "c").collect()}
    assert vc["a"][0] == 2 and vc["a"][1] == pytest.approx(200 / 3)
    assert C.filter_category(df, "c", "すべて").count() == 3            # T18: "all" is no predicate
    assert C.filter_range(df, "x", 1.0, 5.0).count() == 2               # inclusive
    valid, bad = C.split_valid(spark.createDataFrame([("1", "2", "")], "call_id string, customer_id string, agent_id string"))
    assert valid.count() == 0 and bad.first()["reason"] == "missing: agent_id"


def test_label_encodings(spark):
    df = spark.createDataFrame([("未払",), ("支払済",), ("x",), (None,)], "unpaid_flag string")
    a = [r["label"] for r in C.encode_label_a(df).collect()]
    b = [r["label"] for r in C.encode_label_b(df).collect()]
    assert a == [1, 0, 0, 0] and b == [1, 0, 0, 0]
