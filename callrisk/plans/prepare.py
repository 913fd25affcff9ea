"""Queries for sources, projections, filters, imputation, features and
aggregates (SRC, PRJ, FLT, IMP, FE, AGG), each with its DuckDB oracle.

Every query reads whole driver tables through the adapter views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import aggregate as A
from ..operators import clean as C
from ..operators import features as FE
from ..operators import rules as R
from ..session import stored
from ..sources import adapters as AD
from ..sources import events as EV
from .common import REF_TIME, r6
from .oracle import CALL_NUMERIC, FE_A, _cleaned_calls, r6 as s6
from .oracle_views import with_views

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _sel(cols, doubles):
    return ", ".join(f"{s6(c)} AS {c}" if c in doubles else c for c in cols)


# -- sources ---------------------------------------------------------------------------------

@register("target_distribution", with_views("calls") + """
SELECT unpaid_flag, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER () * (1 + 1e-12), 6) + 0.0 AS pct
FROM calls GROUP BY unpaid_flag""")
def q_target_distribution(spark, d):
    """SRC-2 / AGG-4: target distribution of the loaded call table (after the
    required-column check)."""
    calls = EV.require_columns(AD.calls(spark, d), [S.ID_COL, S.TARGET_COL])
    return r6(A.value_counts(calls, S.TARGET_COL, S.TARGET_COL))


@register("crm_lookup", with_views("calls", "crm") + """
SELECT c.contact_id, c.record_no, k.customer_id IS NOT NULL AS found,
       round(k.account_balance * (1 + 1e-12), 6) + 0.0 AS account_balance, k.previous_calls,
       round(k.satisfaction_score * (1 + 1e-12), 6) + 0.0 AS satisfaction_score,
       CAST(len(k.risk_factors) AS BIGINT) AS n_risk_factors
FROM calls c LEFT JOIN crm k ON c.record_no = k.customer_id""")
def q_crm_lookup(spark, d):
    """SRC-4 / JN-1: every call enriched with its CRM record and a found flag."""
    calls = AD.calls(spark, d).select("contact_id", "record_no")
    return r6(EV.lookup_customers(calls, AD.crm(spark, d), "record_no").select(
        "contact_id", "record_no", "found", "account_balance", "previous_calls", "satisfaction_score",
        F.size("risk_factors").cast("long").alias("n_risk_factors")))


@register("crm_flatten", with_views("crm") + """
SELECT CAST(customer_id AS VARCHAR) AS customer_id, name, round(account_balance * (1 + 1e-12), 6) + 0.0 AS account_balance,
       CAST(len(risk_factors) AS BIGINT) AS n_risk_factors, array_to_string(risk_factors, ',') AS risk_factors,
       CAST(previous_calls AS INTEGER) AS previous_calls,
       round(satisfaction_score * (1 + 1e-12), 6) + 0.0 AS satisfaction_score,
       '' AS phone, '' AS email
FROM crm""")
def q_crm_flatten(spark, d):
    """SRC-5: nested CRM records ``{field: {"value": v}}`` (as JSON text built
    from the customer table) parsed and flattened with defaults."""
    raw = EV.crm_records_json(AD.crm(spark, d))
    flat = EV.flatten_crm_records(raw)
    return r6(flat.select("customer_id", "name", "account_balance",
                          F.size("risk_factors").cast("long").alias("n_risk_factors"),
                          F.array_join("risk_factors", ",").alias("risk_factors"),
                          "previous_calls", "satisfaction_score", "phone", "email"))


@register("payment_history", """
SELECT o_custkey AS customer_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
       o_orderstatus AS status FROM orders""")
def q_payment_history(spark, d):
    """SRC-5 (payment statuses): the whole history of every customer in long form."""
    return AD.payment_history(spark, d)


@register("call_history", with_views("calls") + """
SELECT record_no AS customer_id,
       row_number() OVER (PARTITION BY record_no ORDER BY start_ts DESC, contact_id DESC) AS call_rank,
       count(*) OVER (PARTITION BY record_no) AS history_count,
       start_ts AS timestamp, agent AS agent_id,
       round(total_conversation_duration * (1 + 1e-12), 6) + 0.0 AS call_duration,
       round(customer_sentiment_score * (1 + 1e-12), 6) + 0.0 AS sentiment_score,
       unpaid_flag AS payment_outcome
FROM calls""")
def q_call_history(spark, d):
    """SRC-6 / TOP-3: every call of each customer, newest first, with the
    history size (long form; the rank job splits a hot customer)."""
    return r6(EV.call_history(AD.calls(spark, d)))


@register("contact_triggers", with_views("snapshots") + """
SELECT CAST(call_id AS VARCHAR) AS contact_id, CAST(call_id AS VARCHAR) AS customer_id, agent_id,
       ts AS started_at
FROM snapshots WHERE kind = 'START'""")
def q_contact_triggers(spark, d):
    """SRC-8 / ST-9: contact events as JSON, parsed, filtered to
    AGENT_CONNECTED, projected to contact / customer / agent / start time."""
    return EV.contact_triggers(EV.contact_events_json(AD.snapshots(spark, d)))


# -- projections ------------------------------------------------------------------------------

_CALL_KEEP = ["record_no", "unpaid_flag", "contract_date"] + \
    [f"{s}_{x}" for s in ("agent", "customer") for x in
     ("loudness_mean", "negative_sentence", "neutral_sentence", "positive_sentence",
      "sentiment_score", "talktime", "total_sentence")] + \
    ["total_conversation_duration", "total_talktime", "days_call_to_contract", "total_talktime_text"]
_CALL_DOUBLES = {c for c in _CALL_KEEP if c.endswith(("loudness_mean", "sentiment_score", "talktime"))} | \
    {"total_conversation_duration"}


@register("drop_configured", with_views("calls") + f"\nSELECT {_sel(_CALL_KEEP, _CALL_DOUBLES)} FROM calls")
def q_drop_configured(spark, d):
    """PRJ-1: configured columns removed (missing names ignored)."""
    return r6(C.drop_configured(AD.calls(spark, d), list(S.DROP_COLUMNS) + ["not_a_column"]))


@register("parsed_dates", with_views("calls") + """
SELECT contact_id,
       CASE WHEN total_talktime IS NULL THEN 'n/a' ELSE strftime(start_ts, '%Y-%m-%d %H:%M:%S') END AS start_text,
       CASE WHEN total_talktime IS NULL THEN NULL ELSE start_ts END AS start_ts
FROM calls""")
def q_parsed_dates(spark, d):
    """PRJ-4: text dates parsed; text that is not a date becomes null per row."""
    c = AD.calls(spark, d)
    txt = F.when(F.col("total_talktime").isNull(), F.lit("n/a")) \
        .otherwise(F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss"))
    t = c.select("contact_id", txt.alias("start_text"), txt.alias("start_ts"))
    return C.parse_dates(t, ["start_ts"])


@register("label_encoding", with_views("calls") + """
SELECT contact_id, unpaid_flag,
       CASE WHEN unpaid_flag = '未払' THEN 1 ELSE 0 END AS label_a,
       CASE WHEN unpaid_flag = '未払' THEN 1 ELSE 0 END AS label_b,
       CASE WHEN total_talktime IS NULL THEN NULL ELSE unpaid_flag END AS flag_with_nulls,
       CASE WHEN total_talktime IS NOT NULL AND unpaid_flag = '未払' THEN 1 ELSE 0 END AS label_b_nulls
FROM calls""")
def q_label_encoding(spark, d):
    """PRJ-7 / PRJ-8: both label encodings; B maps null and other values to 0."""
    c = AD.calls(spark, d).select("contact_id", "unpaid_flag", "total_talktime")
    c = C.encode_label_a(c, out="label_a").transform(lambda x: C.encode_label_b(x, out="label_b"))
    c = c.withColumn("flag_with_nulls", F.when(F.col("total_talktime").isNotNull(), F.col("unpaid_flag")))
    c = C.encode_label_b(c, "flag_with_nulls", "label_b_nulls")
    return c.select("contact_id", "unpaid_flag", "label_a", "label_b", "flag_with_nulls", "label_b_nulls")


@register("sentence_scatter", with_views("calls") + """
SELECT contact_id, agent_total_sentence, customer_total_sentence FROM calls
WHERE agent_total_sentence IS NOT NULL AND customer_total_sentence IS NOT NULL""")
def q_sentence_scatter(spark, d):
    """PRJ-10: the (agent, customer) sentence pairs behind the scatter view."""
    return AD.calls(spark, d).select("contact_id", "agent_total_sentence", "customer_total_sentence") \
        .dropna(subset=["agent_total_sentence", "customer_total_sentence"])


def _scored_sql_cte():
    from .oracle import _scored_customers_cte
    return _scored_customers_cte()


# -- filters ----------------------------------------------------------------------------------

@register("category_filter", with_views("calls") + """
SELECT contact_id, record_no, agent, unpaid_flag FROM calls WHERE agent = '1-URGENT'""")
def q_category_filter(spark, d):
    """FLT-1: equality filter on a category ("all" would be no predicate)."""
    c = AD.calls(spark, d).select("contact_id", "record_no", "agent", "unpaid_flag")
    assert C.filter_category(c, "agent", "all") is c
    return C.filter_category(c, "agent", "1-URGENT")


@register("score_range_filter", _scored_sql_cte() + """
SELECT record_no, round(risk_score * (1 + 1e-12), 6) + 0.0 AS risk_score FROM scored WHERE risk_score BETWEEN 60 AND 75""")
def q_score_range_filter(spark, d):
    """FLT-2: inclusive score range over the scored customers."""
    from .catalog import scored_customers
    s = scored_customers(spark, d).select("record_no", "risk_score")
    return r6(C.filter_range(s, "risk_score", 60, 75))


@register("request_validation", with_views("snapshots") + """
SELECT event_id, CAST(call_id AS VARCHAR) AS call_id, CAST(call_id AS VARCHAR) AS customer_id,
       CASE WHEN speaker IS NULL THEN NULL ELSE agent_id END AS agent_id,
       speaker IS NOT NULL AS valid,
       CASE WHEN speaker IS NULL THEN 'missing: agent_id' END AS reason
FROM snapshots""")
def q_request_validation(spark, d):
    """FLT-3: score requests lacking call/customer/agent id are quarantined with
    a reason (control events carry no speaking agent)."""
    s = AD.snapshots(spark, d)
    req = s.select("event_id", F.col("call_id").cast("string").alias("call_id"),
                   F.col("call_id").cast("string").alias("customer_id"),
                   F.when(F.col("speaker").isNotNull(), F.col("agent_id")).alias("agent_id"))
    valid, quarantine = C.split_valid(req)
    return (valid.withColumn("valid", F.lit(True)).withColumn("reason", F.lit(None).cast("string"))
            .unionByName(quarantine.withColumn("valid", F.lit(False))))


@register("customer_segments", with_views("segments") + """
SELECT contact_id, segment_id, text FROM segments WHERE speaker = 'CUSTOMER'""")
def q_customer_segments(spark, d):
    """FLT-5: customer turns only."""
    return AD.segments(spark, d).filter(F.col("speaker") == "CUSTOMER").select("contact_id", "segment_id", "text")


# -- imputation -------------------------------------------------------------------------------

_MEDIAN_COLS = ["record_no", "unpaid_flag", "contract_date"] + CALL_NUMERIC + ["total_talktime_text"]


@register("median_filled_calls", with_views("calls") + ",\n" + _cleaned_calls() + f"""
SELECT {_sel(_MEDIAN_COLS, set(CALL_NUMERIC))} FROM cleaned""")
def q_median_filled_calls(spark, d):
    """IMP-1 (call path): configured columns dropped, every numeric column's
    nulls filled with its exact global median."""
    return r6(C.clean_call_records(AD.calls(spark, d)).select(*_MEDIAN_COLS))


@register("mode_filled_speaker", with_views("snapshots") + """,
modes AS (SELECT speaker FROM (SELECT speaker, count(*) AS n FROM snapshots WHERE speaker IS NOT NULL
          GROUP BY speaker) ORDER BY n DESC, speaker LIMIT 1)
SELECT event_id, coalesce(s.speaker, (SELECT speaker FROM modes), 'Unknown') AS speaker FROM snapshots s""")
def q_mode_filled_speaker(spark, d):
    """IMP-2: string nulls filled with the most frequent value (smallest on ties)."""
    s = AD.snapshots(spark, d).select("event_id", "speaker")
    return C.mode_fill(s, ["speaker"])


_FEB_COLS = ["contact_id", "record_no"] + CALL_NUMERIC + ["total_talktime_text"] + list(FE_A)
_FE_B = {
    "agent_customer_talktime_ratio":
        "agent_talktime / CASE WHEN customer_talktime = 0 THEN 0.001 ELSE customer_talktime END",
    "sentiment_difference": "agent_sentiment_score - customer_sentiment_score",
    "avg_sentiment": "(agent_sentiment_score + customer_sentiment_score) / 2",
    "total_sentences": "agent_total_sentence + customer_total_sentence",
    "agent_sentence_ratio": "agent_total_sentence / CASE WHEN agent_total_sentence + customer_total_sentence = 0 "
                            "THEN 1 ELSE agent_total_sentence + customer_total_sentence END",
    "silence_ratio": "1 - total_talktime / CASE WHEN total_conversation_duration = 0 THEN 1 "
                     "ELSE total_conversation_duration END",
    "agent_positivity_ratio": "agent_positive_sentence / CASE WHEN agent_total_sentence = 0 THEN 1 "
                              "ELSE agent_total_sentence END",
    "customer_positivity_ratio": "customer_positive_sentence / CASE WHEN customer_total_sentence = 0 THEN 1 "
                                 "ELSE customer_total_sentence END",
}
_MEANFILL_FEATS = CALL_NUMERIC + ["total_talktime_text"] + list(_FE_B)


def _mean_filled_sql() -> str:
    fe = ", ".join(f"{e} AS {n}" for n, e in _FE_B.items())
    coerced = ", ".join(f"TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS {c}" for c in _MEANFILL_FEATS)
    filled = ", ".join(f"coalesce({c}, (SELECT avg({c}) FROM coerced)) AS {c}" for c in _MEANFILL_FEATS)
    return (with_views("calls") + f",\nfeat AS (SELECT *, {fe} FROM calls),"
            f"\ncoerced AS (SELECT contact_id, record_no, unpaid_flag, {coerced} FROM feat),"
            f"\nfilled AS (SELECT contact_id, record_no, CASE WHEN unpaid_flag = '未払' THEN 1 ELSE 0 END AS label, "
            f"{filled} FROM coerced)"
            f"\nSELECT contact_id, record_no, label, {_sel(_MEANFILL_FEATS, set(_MEANFILL_FEATS))} FROM filled")


@register("mean_filled_features", _mean_filled_sql())
def q_mean_filled_features(spark, d):
    """FE-B -> PRJ-5 -> IMP-3 -> PRJ-8 (the optimisation run's preparation, at
    call grain): zero-guarded features, every feature coerced to double (text
    that is not a number becomes null), nulls filled with column means."""
    c = AD.calls(spark, d).transform(FE.call_features_nonzero)
    c = c.select("contact_id", "record_no", "unpaid_flag", *_MEANFILL_FEATS)
    c = stored(C.coerce_numeric(c, _MEANFILL_FEATS), "coerced-calls")   # read for the means and again to fill
    c = C.mean_fill(c, _MEANFILL_FEATS)
    c = C.encode_label_b(c, out="label")
    return r6(c.select("contact_id", "record_no", "label", *_MEANFILL_FEATS))


_PROFILE_NUM = ["annual_income", "age", "loan_amount", "monthly_income", "credit_score"]
_PROFILE_OUT = ["record_no"] + _PROFILE_NUM + ["unpaid_flag", "debt_to_income", "monthly_burden",
                                                 "age_band", "credit_band"]


def _bins_sql(x, edges):
    parts = [f"WHEN {x} > {edges[i - 1]} AND {x} <= {edges[i]} THEN CAST({float(i)} AS DOUBLE)" for i in range(1, len(edges))]
    return "CASE " + " ".join(parts) + " END"


def _profile_customers_sql() -> str:
    means = ", ".join(f"avg({c}) AS {c}" for c in _PROFILE_NUM)
    filled = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM agg)) AS {c}" for c in _PROFILE_NUM)
    first = ("first_flag AS (SELECT record_no, unpaid_flag FROM (SELECT record_no, unpaid_flag, row_number() OVER "
             "(PARTITION BY record_no ORDER BY start_ts, contact_id) AS rn FROM profile "
             "WHERE unpaid_flag IS NOT NULL AND start_ts IS NOT NULL AND contact_id IS NOT NULL) WHERE rn = 1)")
    feats = (f"loan_amount / (annual_income + 1) AS debt_to_income, "
             f"loan_amount / (monthly_income * 12 + 1) AS monthly_burden, "
             f"coalesce({_bins_sql('age', S.AGE_BINS)}, CAST(0.0 AS DOUBLE)) AS age_band, "
             f"coalesce({_bins_sql('credit_score', S.CREDIT_BINS)}, CAST(0.0 AS DOUBLE)) AS credit_band")
    dbl = set(_PROFILE_NUM) | {"debt_to_income", "monthly_burden", "age_band", "credit_band"}
    return (with_views("profile") + f",\n{first},"
            f"\nagg AS (SELECT p.record_no, {means}, f.unpaid_flag FROM profile p LEFT JOIN first_flag f "
            f"ON p.record_no = f.record_no WHERE p.record_no IS NOT NULL GROUP BY p.record_no, f.unpaid_flag),"
            f"\nfilled AS (SELECT record_no, {filled}, unpaid_flag FROM agg),"
            f"\nfeat AS (SELECT *, {feats} FROM filled)"
            f"\nSELECT {_sel(_PROFILE_OUT, dbl)} FROM feat")


@register("profile_customer_features", _profile_customers_sql())
def q_profile_customer_features(spark, d):
    """Profile path of the preparation run: AGG-1 (means + first target by call
    time) -> PRJ-1 -> IMP-1 -> FE-C -> IMP-4."""
    p = AD.profile(spark, d)
    cust = A.customer_means(p, ["start_ts", "contact_id"])
    cust = (cust.transform(C.drop_configured).transform(C.median_fill)
            .transform(FE.profile_features).transform(lambda x: C.zero_fill(x, ["age_band", "credit_band"])))
    return r6(cust.select(*_PROFILE_OUT))


# -- features at call grain -------------------------------------------------------------------

@register("call_features_a", with_views("calls") + f"""
SELECT contact_id, {", ".join(f"round(({e}) * (1 + 1e-12), 6) + 0.0 AS {n}" if n != "total_sentences"
                              else f"{e} AS {n}" for n, e in FE_A.items())} FROM calls""")
def q_call_features_a(spark, d):
    """FE-A1..A8 at call grain (denominators + 1)."""
    return r6(AD.calls(spark, d).transform(FE.call_features_plus_one).select("contact_id", *FE_A))


@register("call_features_b", with_views("calls") + f"""
SELECT contact_id, {", ".join(f"round(({e}) * (1 + 1e-12), 6) + 0.0 AS {n}" if n != "total_sentences"
                              else f"{e} AS {n}" for n, e in _FE_B.items())} FROM calls""")
def q_call_features_b(spark, d):
    """FE-B1..B8 at call grain (zero denominators replaced)."""
    return r6(AD.calls(spark, d).transform(FE.call_features_nonzero).select("contact_id", *_FE_B))


@register("profile_features", with_views("profile") + f"""
SELECT contact_id, round((loan_amount / (annual_income + 1)) * (1 + 1e-12), 6) + 0.0 AS debt_to_income,
       round((loan_amount / (monthly_income * 12 + 1)) * (1 + 1e-12), 6) + 0.0 AS monthly_burden,
       {_bins_sql('age', S.AGE_BINS)} AS age_band, {_bins_sql('credit_score', S.CREDIT_BINS)} AS credit_band
FROM profile""")
def q_profile_features(spark, d):
    """FE-C1..C4 per record: debt ratios and right-closed age / credit bands."""
    return r6(AD.profile(spark, d).transform(FE.profile_features)
              .select("contact_id", "debt_to_income", "monthly_burden", "age_band", "credit_band"))


_VEC_SQL = with_views("snapshots", "crm") + """
SELECT s.event_id,
       coalesce(s.agent_sentiment, 0.0) AS f1, round(coalesce(s.customer_sentiment, 0.0) * (1 + 1e-12), 6) + 0.0 AS f2,
       CAST(0.0 AS DOUBLE) AS f3, CAST(0.5 AS DOUBLE) AS f4, CAST(0.1 AS DOUBLE) AS f5,
       round(coalesce(k.account_balance, 0.0) * (1 + 1e-12), 6) + 0.0 AS f6, CAST(coalesce(k.previous_calls, 0) AS DOUBLE) AS f7,
       round(coalesce(k.satisfaction_score, 3.0) * (1 + 1e-12), 6) + 0.0 AS f8,
       CAST(coalesce(k.payment_count, 0) AS DOUBLE) AS f9, CAST(coalesce(len(k.risk_factors), 0) AS DOUBLE) AS f10,
       CAST({size} AS BIGINT) AS vector_size, CAST(0.0 AS DOUBLE) AS padding_sum
FROM snapshots s LEFT JOIN crm k ON s.call_id = k.customer_id"""


def _vector_columns(df, n):
    return [F.col("features")[i].alias(f"f{i + 1}") for i in range(n)]


@register("realtime_vectors", _VEC_SQL.replace("{size}", "25"))
def q_realtime_vectors(spark, d):
    """FE-D1: the live 10-feature vector padded with zeros to 25."""
    s = AD.snapshots(spark, d)
    j = EV.lookup_customers(s, AD.crm(spark, d), "call_id")
    v = FE.realtime_vector(j)
    return r6(v.select("event_id", *_vector_columns(v, 10), F.size("features").cast("long").alias("vector_size"),
                       F.aggregate(F.slice("features", 11, 15), F.lit(0.0), lambda a, x: a + x)
                       .alias("padding_sum")))


@register("production_vectors", with_views("snapshots", "crm") + """,
hist AS (SELECT record_no, count(*) AS n FROM (SELECT o_custkey AS record_no FROM orders) GROUP BY record_no)
SELECT s.event_id, coalesce(s.agent_sentiment, 0.0) AS f1,
       round(coalesce(s.customer_sentiment, 0.0) * (1 + 1e-12), 6) + 0.0 AS f2, CAST(0.0 AS DOUBLE) AS f3,
       CAST(0.0 AS DOUBLE) AS f4, CAST(0.0 AS DOUBLE) AS f5,
       round(coalesce(k.account_balance, 0.0) * (1 + 1e-12), 6) + 0.0 AS f6,
       CAST(coalesce(k.previous_calls, 0) AS DOUBLE) AS f7, CAST(coalesce(h.n, 0) AS DOUBLE) AS f8
FROM snapshots s LEFT JOIN crm k ON s.call_id = k.customer_id LEFT JOIN hist h ON s.call_id = h.record_no""")
def q_production_vectors(spark, d):
    """FE-D2: 5 call features, balance, previous calls, size of the call history."""
    s = AD.snapshots(spark, d)
    j = EV.lookup_customers(s, AD.crm(spark, d), "call_id")
    hist = AD.calls(spark, d).groupBy(F.col("record_no").alias("call_id")).agg(
        F.count(F.lit(1)).alias("history_count"))
    j = j.join(hist, "call_id", "left")
    v = FE.production_vector(j)
    return r6(v.select("event_id", *_vector_columns(v, 8)))


# -- aggregates -------------------------------------------------------------------------------

_FIRST_NUM = [c for c in CALL_NUMERIC]


def _first_flag_sql():
    means = ", ".join(f"round(avg({c}) * (1 + 1e-12), 6) + 0.0 AS {c}" for c in _FIRST_NUM)
    return (with_views("calls") + """,
firsts AS (SELECT record_no, unpaid_flag FROM (SELECT record_no, unpaid_flag, row_number() OVER
   (PARTITION BY record_no ORDER BY start_ts, contact_id) AS rn FROM calls
   WHERE unpaid_flag IS NOT NULL AND start_ts IS NOT NULL AND contact_id IS NOT NULL) WHERE rn = 1)
""" + f"SELECT c.record_no, {means}, f.unpaid_flag FROM calls c LEFT JOIN firsts f ON c.record_no = f.record_no "
          "WHERE c.record_no IS NOT NULL GROUP BY c.record_no, f.unpaid_flag")


@register("customer_first_flag", _first_flag_sql())
def q_customer_first_flag(spark, d):
    """AGG-1 / AGG-3: per customer mean of every numeric column and the first
    non-null target in call order (start time, contact id)."""
    c = AD.calls(spark, d).drop("contract_date", "total_talktime_text", "agent")
    return r6(A.customer_means(c, ["start_ts", "contact_id"]).select("record_no", *_FIRST_NUM, "unpaid_flag"))


_BAND = "CASE WHEN {x} >= 70 THEN '高リスク' WHEN {x} >= 40 THEN '中リスク' ELSE '低リスク' END"


@register("band_counts", _scored_sql_cte() + f"""
SELECT {_BAND.format(x='risk_score')} AS risk_category, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER () * (1 + 1e-12), 6) + 0.0 AS pct
FROM scored GROUP BY 1""")
def q_band_counts(spark, d):
    """AGG-4 / AGG-9: customers and share per live band."""
    from .catalog import scored_customers
    return r6(A.band_distribution(scored_customers(spark, d), "risk_category"))


@register("score_summary", _scored_sql_cte() + """
SELECT count(risk_score) AS n, round(avg(100 - risk_score) * (1 + 1e-12), 6) + 0.0 AS mean,
       round(stddev_pop(100 - risk_score) * (1 + 1e-12), 6) + 0.0 AS std,
       round(min(100 - risk_score) * (1 + 1e-12), 6) + 0.0 AS min, round(max(100 - risk_score) * (1 + 1e-12), 6) + 0.0 AS max
FROM scored""")
def q_score_summary(spark, d):
    """AGG-5: n, mean, population std, min, max of the batch safety score."""
    from .catalog import scored_customers
    s = scored_customers(spark, d).withColumn("safety", R.safety_score(F.col("risk_score") / 100.0))
    return r6(A.score_summary(s, "safety"))


@register("dashboard_summary", _scored_sql_cte() + f"""
SELECT round(avg(risk_score) * (1 + 1e-12), 6) + 0.0 AS mean,
       round(avg(CASE WHEN {_BAND.format(x='risk_score')} = '高リスク' THEN 1.0 ELSE 0.0 END) * 100 * (1 + 1e-12), 6) + 0.0
         AS high_pct,
       round(stddev_samp(risk_score) * (1 + 1e-12), 6) + 0.0 AS std
FROM scored""")
def q_dashboard_summary(spark, d):
    """AGG-6: mean, high-band share, sample std."""
    from .catalog import scored_customers
    return r6(A.dashboard_summary(scored_customers(spark, d), "risk_score", "risk_category", "高リスク"))


@register("kpi_overview", _scored_sql_cte() + f""",
lab AS (SELECT s.*, CASE WHEN m.unpaid_flag = '未払' THEN 1 ELSE 0 END AS label,
               CASE WHEN s.risk_score / 100.0 >= 0.5 THEN 1 ELSE 0 END AS pred
        FROM scored s JOIN modes m ON s.record_no = m.record_no)
SELECT count(*) AS total, CAST(count_if({_BAND.format(x='risk_score')} = '高リスク') AS BIGINT) AS high_risk,
       round(avg(risk_score) * (1 + 1e-12), 6) + 0.0 AS mean_score,
       round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) * (1 + 1e-12), 6) + 0.0 AS accuracy
FROM lab""")
def q_kpi_overview(spark, d):
    """AGG-7: total, high-band count, mean score and accuracy of the rule at 0.5."""
    from .catalog import scored_customers
    s = scored_customers(spark, d, with_label=True)
    s = s.withColumn("pred", (F.col("risk_score") / 100.0 >= 0.5).cast("int"))
    return r6(A.kpi_overview(s, "risk_score", "risk_category", "高リスク", "label", "pred"))


@register("distinct_customers", with_views("calls") + """
SELECT count(DISTINCT record_no) AS customers FROM calls""")
def q_distinct_customers(spark, d):
    """AGG-8: exact number of distinct customers."""
    return A.distinct_customers(AD.calls(spark, d))


@register("live_gauges", with_views("snapshots") + f""",
ctl AS (SELECT call_id, agent_id, kind, ts, event_id FROM snapshots WHERE kind IN ('START', 'END')
        AND ts <= TIMESTAMP '{REF_TIME}'),
last_ctl AS (SELECT call_id, arg_max(kind, (epoch_us(ts), event_id)) AS kind,
                    arg_max(agent_id, (epoch_us(ts), event_id)) AS agent_id FROM ctl GROUP BY call_id)
SELECT count(*) AS active_calls, count(DISTINCT agent_id) AS active_agents FROM last_ctl WHERE kind = 'START'""")
def q_live_gauges(spark, d):
    """AGG-10: calls whose last control event by the reference time is a start,
    and their distinct agents."""
    state = EV.session_state_at(AD.snapshots(spark, d), REF_TIME)
    return A.live_gauges(state)
