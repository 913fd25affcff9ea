"""Call-session rules on the micro-cases of FIXTURES §C, and profiling edge cases."""

from pyspark.sql import functions as F

from callrisk.operators import profile as P
from callrisk.operators import sessions as SE

EVENTS = [  # event_id, call_id, minute, kind
    (1, 1, 0, "SEGMENT"),   # score before start -> rejected
    (2, 1, 1, "START"),
    (3, 1, 2, "SEGMENT"),
    (4, 1, 3, "END"),
    (5, 1, 4, "SEGMENT"),   # score after end -> rejected
    (6, 1, 5, "END"),       # end without start -> rejected
    (7, 2, 0, "START"),     # never ends -> active
    (8, 2, 1, "SEGMENT"),
    (9, 3, 0, "START"),     # replaced by the next start
    (10, 3, 1, "SEGMENT"),
    (11, 3, 2, "START"),
    (12, 3, 3, "END"),
]


def _events(spark):
    df = spark.createDataFrame(EVENTS, "event_id long, call_id long, minute int, kind string")
    return df.select("event_id", "call_id", "kind",
                     (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("minute")))
                     .alias("ts"),
                     F.concat(F.lit("agent-"), F.col("call_id").cast("string")).alias("agent_id"),
                     F.lit(-0.6).alias("customer_sentiment"))


def _crm(spark):
    return spark.createDataFrame([(1, 1000.0, ["a", "b", "c"]), (2, 40000.0, []), (3, 10000.0, ["a"])],
                                 "customer_id long, account_balance double, risk_factors array<string>")


def test_event_outcomes(spark):
    out = {r["event_id"]: (r["session_no"], r["outcome"]) for r in SE.classify_events(_events(spark)).collect()}
    assert out[1] == (0, "REJECTED") and out[2] == (1, "OPENED") and out[3] == (1, "SCORED")
    assert out[4] == (1, "CLOSED") and out[5] == (1, "REJECTED") and out[6] == (1, "REJECTED")
    assert out[8] == (1, "SCORED") and out[11] == (2, "OPENED") and out[12] == (2, "CLOSED")


def test_session_summaries(spark):
    rows = {(r["call_id"], r["session_no"]): r for r in SE.session_summaries(_events(spark), _crm(spark)).collect()}
    assert rows[(1, 1)]["status"] == "ENDED" and rows[(1, 1)]["duration_s"] == 120.0
    assert rows[(1, 1)]["n_scores"] == 1 and rows[(1, 1)]["final_score"] == 100.0   # 50+20+15+15
    assert rows[(2, 1)]["status"] == "ACTIVE" and rows[(2, 1)]["final_score"] == 60.0   # 50+20-10
    assert rows[(3, 1)]["status"] == "REPLACED" and rows[(3, 2)]["status"] == "ENDED"
    assert rows[(3, 2)]["n_scores"] == 0 and rows[(3, 2)]["final_score"] is None
    assert len(rows) == 4


def test_state_at_reference_time(spark):
    at = "2024-01-01 00:02:30"
    st = {r["call_id"]: r["status"] for r in SE.session_states(_events(spark), at).collect()}
    assert st == {1: "ACTIVE", 2: "ACTIVE", 3: "ACTIVE"}
    att = {r["call_id"]: r["talk_time"] for r in SE.contact_attributes(_events(spark), at).collect()}
    assert att[1] == 90.0 and att[3] == 30.0


def test_profile_edge_cases(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (None, 1.0, "b")], "x double, y double, s string")
    h = P.histogram(df, "x", 4).collect()
    assert len(h) == 4 and all(r["n"] == 0 for r in h)
    assert P.correlation_long(df, ["y"]).count() == 0
    assert P.dtype_counts(df) == [("double", 2), ("string", 1)]
    d = {r["column"]: r for r in P.describe(df, ["y"]).collect()}
    assert d["y"]["q50"] == 1.0 and d["y"]["count"] == 2
