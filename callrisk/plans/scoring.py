"""Queries for scores, bands, decision rules, transcript views, profiling,
splits and metrics (SC, TOP, PRF, ML-1/2, MET), each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import hashing as H
from ..functions.ranking import auc_from_scores, roc_points
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import rules as R
from ..operators import transcripts as TR
from ..sources import adapters as AD
from ..sources import events as EV
from .common import r6
from .oracle import CALL_NUMERIC, _scored_customers_cte
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


def x6(c: str) -> str:
    return f"round(({c}) * (1 + 1e-12), 6) + 0.0"


_RULE = ("CAST(greatest(0.0, least(100.0, 50.0"
         " + CASE WHEN coalesce({s}, 0) < -0.5 THEN 20.0 WHEN coalesce({s}, 0) < 0 THEN 10.0 ELSE 0.0 END"
         " + CASE WHEN coalesce({b}, 0) < 5000 THEN 15.0 WHEN coalesce({b}, 0) > 30000 THEN -10.0 ELSE 0.0 END"
         " + coalesce(len({f}), 0) * 5.0)) AS DOUBLE)")


def _band_sql(x, cuts, labels, strict=False):
    op = ">" if strict else ">="
    parts = " ".join(f"WHEN {x} {op} {c} THEN '{lab}'" for c, lab in zip(cuts, labels))
    return f"CASE WHEN {x} IS NULL THEN NULL {parts} ELSE '{labels[-1]}' END"


def _live_rows(spark, d):
    """Snapshot events joined to their CRM record."""
    return EV.lookup_customers(AD.snapshots(spark, d), AD.crm(spark, d), "call_id")


_LIVE_CTE = with_views("snapshots", "crm") + f""",
live AS (SELECT s.*, k.customer_id, k.account_balance, k.risk_factors,
                {_RULE.format(s='s.customer_sentiment', b='k.account_balance', f='k.risk_factors')} AS rule
         FROM snapshots s LEFT JOIN crm k ON s.call_id = k.customer_id)"""


# -- scores and bands -------------------------------------------------------------------------

@register("safety_bands", _scored_customers_cte() + f"""
SELECT record_no, {x6('risk_score / 100.0')} AS p_default, {x6('(1 - risk_score / 100.0) * 100')} AS safety_score,
       {_band_sql('(1 - risk_score / 100.0) * 100', (70, 40), S.BATCH_LABELS)} AS risk_category
FROM scored""")
def q_safety_bands(spark, d):
    """SC-1 / SC-2: batch safety score (1 - p) * 100 and its band (high = safe)."""
    from .catalog import scored_customers
    s = scored_customers(spark, d).withColumn("p_default", F.col("risk_score") / 100.0)
    safety = R.safety_score("p_default")
    return r6(s.select("record_no", "p_default", safety.alias("safety_score"),
                       R.safety_band(safety).alias("risk_category")))


@register("realtime_scores", _LIVE_CTE + f"""
SELECT event_id, round_even(rule / 100.0 * 100.0, 2) AS risk_score,
       {_band_sql('rule', (70, 40), S.REALTIME_LABELS)} AS risk_level,
       round_even(greatest(rule / 100.0, 1 - rule / 100.0), 3) AS confidence
FROM live""")
def q_realtime_scores(spark, d):
    """SC-3 / SC-5 / SC-12: danger score p * 100 (half-even to 2 digits), live
    band and model confidence max(p, 1 - p) (half-even to 3 digits)."""
    j = _live_rows(spark, d).withColumn("p", R.rule_score() / 100.0)
    return r6(j.select("event_id", R.danger_score("p").alias("risk_score"),
                       R.realtime_band(R.rule_score()).alias("risk_level"),
                       R.model_confidence("p").alias("confidence")))


def _mobile_sql():
    lv = _band_sql("rule", (60, 35), ("high", "medium", "low"))
    rec = " ".join(f"WHEN '{k}' THEN '{'|'.join(v)}'" for k, v in S.MOBILE_RECOMMENDATIONS.items())
    pri = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.MOBILE_PRIORITY.items())
    return (_LIVE_CTE + f""",
lv AS (SELECT event_id, rule, {lv} AS level FROM live)
SELECT event_id, {x6('rule')} AS risk_score, {_band_sql('rule', (60, 35), S.MOBILE_LABELS)} AS mobile_level,
       CASE level {rec} END AS recommendations, CASE level {pri} END AS priority_class
FROM lv""")


@register("mobile_recommendations", _mobile_sql())
def q_mobile_recommendations(spark, d):
    """SC-6 / SC-10: mobile band (60 / 35), five texts per band and the
    priority class, through a three-row band dimension."""
    j = _live_rows(spark, d).withColumn("risk_score", R.rule_score())
    m = R.mobile_recommendations(j, "risk_score")
    return r6(m.select("event_id", "risk_score", R.mobile_band("risk_score").alias("mobile_level"),
                       F.array_join("recommendations", "|").alias("recommendations"), "priority_class"))


@register("widget_labels", _LIVE_CTE + f"""
SELECT event_id, {_band_sql('rule', (60, 40), S.WIDGET_LABELS)} AS widget_level,
       CASE WHEN customer_sentiment IS NULL THEN NULL WHEN customer_sentiment > 0.3 THEN 'Positive'
            WHEN customer_sentiment < -0.3 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label
FROM live""")
def q_widget_labels(spark, d):
    """SC-7 / SC-13: web widget band (60 / 40) and sentiment label."""
    j = _live_rows(spark, d)
    return j.select("event_id", R.widget_band(R.rule_score()).alias("widget_level"),
                    R.sentiment_label("customer_sentiment").alias("sentiment_label"))


@register("call_routing", _LIVE_CTE + f""",
r AS (SELECT event_id, rule, {_band_sql('rule', (70, 40), ('HighRiskFlow', 'MediumRiskFlow', 'LowRiskFlow'), True)}
      AS flow FROM live WHERE kind = 'START')
SELECT event_id, flow, flow = 'HighRiskFlow' AS transfer,
       CASE flow WHEN 'MediumRiskFlow' THEN 'medium' WHEN 'LowRiskFlow' THEN 'low' END AS risk_level,
       CASE WHEN flow = 'MediumRiskFlow' THEN 'false' END AS escalation_required,
       CASE WHEN flow = 'LowRiskFlow' THEN 'true' END AS upsell_opportunity,
       CASE WHEN flow <> 'HighRiskFlow' THEN '{S.ROUTE_STANDARD_MESSAGE}' END AS message,
       flow <> 'HighRiskFlow' AS to_queue
FROM r""")
def q_call_routing(spark, d):
    """SC-8: routing of each incoming contact by its danger score (strict > 70
    transfer to the high-risk flow, > 40 medium attributes, else low)."""
    j = _live_rows(spark, d).filter(F.col("kind") == "START")
    r = j.select("event_id", R.routing(R.rule_score()).alias("r"))
    return r.select("event_id", F.col("r.flow").alias("flow"), F.col("r.transfer").alias("transfer"),
                    F.col("r.attributes")["risk_level"].alias("risk_level"),
                    F.col("r.attributes")["escalation_required"].alias("escalation_required"),
                    F.col("r.attributes")["upsell_opportunity"].alias("upsell_opportunity"),
                    F.col("r.message").alias("message"), F.col("r.to_queue").alias("to_queue"))


def _live_results_sql():
    lv = _band_sql("rule", (70, 40), ("high", "medium", "low"))
    rec = " ".join(f"WHEN '{k}' THEN '{'|'.join(v)}'" for k, v in S.AGENT_RECOMMENDATIONS.items())
    return (_LIVE_CTE + f""",
lv AS (SELECT *, {lv} AS level FROM live WHERE kind = 'SEGMENT')
SELECT event_id, CAST(call_id AS VARCHAR) AS call_id,
       CASE WHEN customer_id IS NOT NULL THEN round_even(rule, 2) END AS risk_score,
       CASE WHEN customer_id IS NOT NULL THEN {_band_sql('rule', (70, 40), S.REALTIME_LABELS)} END AS risk_level,
       CASE WHEN customer_id IS NOT NULL THEN CAST(0.85 AS DOUBLE) END AS confidence,
       CASE WHEN customer_id IS NOT NULL THEN (CASE level {rec} END) ||
            CASE WHEN coalesce(customer_sentiment, 0) < -0.3 THEN '|{S.AGENT_UNHAPPY_RECOMMENDATION}' ELSE '' END
       END AS recommendations,
       CASE WHEN customer_id IS NOT NULL THEN array_to_string(list_filter([
            CASE WHEN coalesce(customer_sentiment, 0) < -0.3 THEN '{S.RISK_FACTOR_NEGATIVE_SENTIMENT}' END,
            CASE WHEN coalesce(account_balance, 0) < 5000 THEN '{S.RISK_FACTOR_LOW_BALANCE}' END,
            CASE WHEN coalesce(len(risk_factors), 0) > 2 THEN '{S.RISK_FACTOR_MANY_PAST}' END],
            lambda x: x IS NOT NULL), ', ') END AS factors,
       CASE WHEN customer_id IS NULL THEN 'customer not found' END AS error,
       ts AS scored_at
FROM lv""")


@register("live_results", _live_results_sql())
def q_live_results(spark, d):
    """SC-16 with SC-9 / SC-11: the live result record of every transcript
    snapshot (score, band, confidence, recommendations, factors, time)."""
    j = _live_rows(spark, d).filter(F.col("kind") == "SEGMENT")
    res = R.score_live(j)
    return r6(res.select("event_id", F.col("call_id").cast("string").alias("call_id"), "risk_score",
                         F.col("risk_category").alias("risk_level"), "confidence",
                         F.array_join("recommendations", "|").alias("recommendations"),
                         F.array_join("factors", ", ").alias("factors"), "error", "scored_at"))


# -- transcript views -------------------------------------------------------------------------

_BUF_CTE = with_views("segments") + """,
buf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY segment_id DESC) AS pos
        FROM segments) WHERE pos <= 10)"""


@register("segment_buffer", _BUF_CTE + """
SELECT contact_id, segment_id, pos, speaker FROM buf""")
def q_segment_buffer(spark, d):
    """TOP-4 / ST-3: the last ten segments of every contact (pos 1 = newest)."""
    return TR.segment_buffer(AD.segments(spark, d)).select("contact_id", "segment_id", "pos", "speaker")


@register("latest_segment", with_views("segments") + """
SELECT contact_id, max(segment_id) AS latest_segment_id,
       arg_max(speaker, segment_id) AS latest_speaker, least(CAST(count(*) AS BIGINT), 10) AS segment_count,
       CAST(max(epoch_s) - min(epoch_s) AS BIGINT) AS call_duration
FROM segments GROUP BY contact_id""")
def q_latest_segment(spark, d):
    """TOP-5 / ST-4: latest segment, buffered count and seconds since the first segment per contact."""
    return TR.transcript_view(AD.segments(spark, d))


@register("first_customer_segment", with_views("segments") + """
SELECT contact_id, arg_min(segment_id, segment_id) AS first_segment_id,
       round(arg_min(negative_score, segment_id) * (1 + 1e-12), 6) + 0.0 AS first_negative
FROM segments WHERE speaker = 'CUSTOMER' GROUP BY contact_id""")
def q_first_customer_segment(spark, d):
    """TOP-6: first customer segment of each contact."""
    s = AD.segments(spark, d).filter(F.col("speaker") == "CUSTOMER")
    return r6(s.groupBy("contact_id").agg(
        F.min("segment_id").alias("first_segment_id"),
        F.min_by("sentiment.negative_score", "segment_id").alias("first_negative")))


@register("call_sentiment", _BUF_CTE + """,
cust AS (SELECT contact_id, arg_min(negative_score, segment_id) AS first_neg,
                arg_max(positive_score, segment_id) AS last_pos
         FROM buf WHERE speaker = 'CUSTOMER' GROUP BY contact_id),
ids AS (SELECT DISTINCT contact_id FROM buf),
imp AS (SELECT i.contact_id, c.last_pos - c.first_neg AS improvement, c.contact_id IS NOT NULL AS has_customer
        FROM ids i LEFT JOIN cust c ON i.contact_id = c.contact_id)
SELECT contact_id, round(improvement * (1 + 1e-12), 6) + 0.0 AS improvement_score,
       CASE WHEN NOT has_customer THEN 'NEUTRAL' WHEN improvement > 0.3 THEN 'POSITIVE'
            WHEN improvement > -0.2 THEN 'NEUTRAL' ELSE 'NEGATIVE' END AS overall_sentiment,
       CASE WHEN NOT has_customer THEN NULL WHEN improvement > 0.2 THEN 'IMPROVING'
            WHEN improvement > -0.2 THEN 'STABLE' ELSE 'DECLINING' END AS satisfaction_trend,
       CAST(CASE WHEN has_customer THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence
FROM imp""")
def q_call_sentiment(spark, d):
    """SC-14: overall call sentiment over the buffered segments (customer turns:
    last positive minus first negative)."""
    return r6(TR.overall_sentiment(TR.segment_buffer(AD.segments(spark, d))))


@register("call_summaries", _BUF_CTE + f"""
SELECT contact_id, CAST(count(*) AS BIGINT) AS total_segments, '{S.SUMMARY_CALL_TYPE}' AS call_type,
       CASE WHEN count(*) > 5 THEN 'RESOLVED' ELSE 'IN_PROGRESS' END AS resolution_status,
       count(*) > 8 AS follow_up_required, false AS escalation_occurred,
       '{','.join(S.SUMMARY_TOPICS)}' AS key_topics
FROM buf GROUP BY contact_id""")
def q_call_summaries(spark, d):
    """SC-15: call summary from the buffered segment count."""
    s = TR.call_summary(TR.segment_buffer(AD.segments(spark, d)))
    return s.withColumn("key_topics", F.array_join("key_topics", ","))


# -- profiling --------------------------------------------------------------------------------

_CALL_ALL = ["record_no", "unpaid_flag", "contract_date", "start_ts", "contact_id", "agent"] + CALL_NUMERIC + \
    ["total_talktime_text"]


@register("null_profile", with_views("calls") + """
SELECT * FROM (UNPIVOT (SELECT """ + ", ".join(f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}" for c in _CALL_ALL)
          + """ FROM calls) ON COLUMNS(*) INTO NAME "column" VALUE nulls) WHERE nulls > 0""")
def q_null_profile(spark, d):
    """PRF-1: null count of every column (only columns with nulls), one pass."""
    return P.null_profile(AD.calls(spark, d).select(*_CALL_ALL))


_MASK_COLS = [c for c in _CALL_ALL if c != "contact_id"]


@register("null_mask", with_views("calls") + "\nSELECT contact_id, "
          + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in _MASK_COLS) + " FROM calls")
def q_null_mask(spark, d):
    """PRF-1 mask: row x column null indicators."""
    return P.null_mask(AD.calls(spark, d).select("contact_id", *_MASK_COLS), "contact_id")


_DESC_COLS = CALL_NUMERIC


@register("describe_calls", with_views("calls") + """,
l AS (SELECT "column", CAST(value AS DOUBLE) AS value FROM (UNPIVOT (SELECT """
          + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _DESC_COLS)
          + """ FROM calls) ON COLUMNS(*) INTO NAME "column" VALUE value) WHERE value IS NOT NULL)
SELECT "column", count(*) AS count, round(avg(value) * (1 + 1e-12), 6) + 0.0 AS mean,
       round(stddev_samp(value) * (1 + 1e-12), 6) + 0.0 AS std, round(min(value) * (1 + 1e-12), 6) + 0.0 AS min,
       round(max(value) * (1 + 1e-12), 6) + 0.0 AS max,
       round(quantile_cont(value, 0.25) * (1 + 1e-12), 6) + 0.0 AS q25,
       round(quantile_cont(value, 0.5) * (1 + 1e-12), 6) + 0.0 AS q50,
       round(quantile_cont(value, 0.75) * (1 + 1e-12), 6) + 0.0 AS q75
FROM l GROUP BY "column\"""")
def q_describe_calls(spark, d):
    """PRF-2: count, mean, std, min, exact quartiles, max per numeric column."""
    return r6(P.describe(AD.calls(spark, d), _DESC_COLS))


@register("duplicate_calls", with_views("calls") + """
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates
FROM (SELECT """ + ", ".join(_CALL_ALL) + """, count(*) AS n FROM calls GROUP BY ALL)""")
def q_duplicate_calls(spark, d):
    """PRF-4: rows beyond the first row that is identical in every column."""
    c = AD.calls(spark, d).select(*_CALL_ALL)
    return P.duplicate_rows(c).select(F.col("rows").cast("long").alias("rows"),
                                      F.col("distinct_rows").cast("long").alias("distinct_rows"),
                                      F.col("duplicates").cast("long").alias("duplicates"))


def _hist_sql(view, col, bins):
    return (with_views(view) + f""",
st AS (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {view}),
b AS (SELECT CASE WHEN st.hi = st.lo THEN 1 ELSE
             least(CAST(floor((CAST({col} AS DOUBLE) - st.lo) * {bins} / (st.hi - st.lo)) AS BIGINT) + 1, {bins}) END AS bin
      FROM {view}, st WHERE {col} IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(r.bin AS INTEGER) AS bin, {x6(f'st.lo + (r.bin - 1) * ((st.hi - st.lo) / {bins})')} AS lo,
       {x6(f'st.lo + r.bin * ((st.hi - st.lo) / {bins})')} AS hi, coalesce(c.n, 0) AS n
FROM range(1, {bins + 1}) r(bin) CROSS JOIN st LEFT JOIN c ON r.bin = c.bin""")


@register("sentiment_histogram", _hist_sql("calls", "customer_sentiment_score", 20))
def q_sentiment_histogram(spark, d):
    """PRF-5: 20 equal-width bins of the customer sentiment score (empty bins kept)."""
    return r6(P.histogram(AD.calls(spark, d), "customer_sentiment_score", 20))


@register("duration_histogram", _hist_sql("calls", "total_conversation_duration", 30))
def q_duration_histogram(spark, d):
    """PRF-5: 30 equal-width bins of the conversation duration."""
    return r6(P.histogram(AD.calls(spark, d), "total_conversation_duration", 30))


@register("sentiment_box_by_flag", with_views("calls") + """,
q AS (SELECT unpaid_flag, count(customer_sentiment_score) AS n,
             quantile_cont(customer_sentiment_score, 0.25) AS q1, quantile_cont(customer_sentiment_score, 0.5) AS median,
             quantile_cont(customer_sentiment_score, 0.75) AS q3 FROM calls
      WHERE customer_sentiment_score IS NOT NULL GROUP BY unpaid_flag)
SELECT q.unpaid_flag, q.n, round(q.q1 * (1 + 1e-12), 6) + 0.0 AS q1, round(q.median * (1 + 1e-12), 6) + 0.0 AS median,
       round(q.q3 * (1 + 1e-12), 6) + 0.0 AS q3, round((q.q3 - q.q1) * (1 + 1e-12), 6) + 0.0 AS iqr,
       round(min(CASE WHEN x >= q.q1 - 1.5 * (q.q3 - q.q1) THEN x END) * (1 + 1e-12), 6) + 0.0 AS whisker_lo,
       round(max(CASE WHEN x <= q.q3 + 1.5 * (q.q3 - q.q1) THEN x END) * (1 + 1e-12), 6) + 0.0 AS whisker_hi,
       CAST(count_if(x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) AS BIGINT) AS outliers
FROM (SELECT unpaid_flag, customer_sentiment_score AS x FROM calls WHERE customer_sentiment_score IS NOT NULL) c
JOIN q ON c.unpaid_flag = q.unpaid_flag
GROUP BY q.unpaid_flag, q.n, q.q1, q.median, q.q3""")
def q_sentiment_box_by_flag(spark, d):
    """PRF-6: box statistics of customer sentiment per payment flag."""
    return r6(P.box_stats(AD.calls(spark, d), "customer_sentiment_score", "unpaid_flag"))


_CORR_COLS = CALL_NUMERIC


def _corr_sql():
    from itertools import combinations
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, {x6(f'corr({a}, {b})')} AS corr FROM calls"
             for a, b in combinations(_CORR_COLS, 2)]
    return with_views("calls") + "\n" + "\nUNION ALL ".join(parts)


@register("correlations", _corr_sql())
def q_correlations(spark, d):
    """PRF-7: Pearson correlation of every column pair (pairwise null dropping)."""
    return r6(P.correlation_long(AD.calls(spark, d), _CORR_COLS))


def _score_box_sql(by: str, source: str) -> str:
    """Box statistics of ``x`` per ``by`` over the common table expression text ``source`` (which ends in b)."""
    return source + f""",
q AS (SELECT {by}, count(x) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM b GROUP BY {by})
SELECT q.{by}, q.n, {x6('q.q1')} AS q1, {x6('q.median')} AS median, {x6('q.q3')} AS q3, {x6('q.q3 - q.q1')} AS iqr,
       {x6('min(CASE WHEN x >= q.q1 - 1.5 * (q.q3 - q.q1) THEN x END)')} AS whisker_lo,
       {x6('max(CASE WHEN x <= q.q3 + 1.5 * (q.q3 - q.q1) THEN x END)')} AS whisker_hi,
       CAST(count_if(x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) AS BIGINT) AS outliers
FROM b JOIN q ON b.{by} = q.{by} GROUP BY q.{by}, q.n, q.q1, q.median, q.q3"""


@register("score_box_by_flag", _score_box_sql("unpaid_flag", _scored_customers_cte() + """,
b AS (SELECT m.unpaid_flag, s.risk_score AS x FROM scored s JOIN modes m ON s.record_no = m.record_no)"""))
def q_score_box_by_flag(spark, d):
    """PRF-6: quartiles, whiskers and outliers of the risk score per payment flag."""
    from .catalog import scored_customers
    scored = scored_customers(spark, d, with_label=True)
    flag = F.when(F.col("label") == 1, S.TARGET_UNPAID).otherwise(S.TARGET_PAID)
    return r6(P.box_stats(scored.withColumn("unpaid_flag", flag), "risk_score", "unpaid_flag"))


def _age_source() -> str:
    from .prepare import _profile_customers_sql
    scored = _scored_customers_cte()[len(with_views("calls", "crm")):]
    profile = _profile_customers_sql()[len(with_views("profile")):].rsplit("\nSELECT ", 1)[0]
    return with_views("calls", "crm", "profile") + scored + profile + """,
b AS (SELECT f.age_band, s.risk_score AS x FROM scored s JOIN feat f ON s.record_no = f.record_no)"""


@register("score_box_by_age", _score_box_sql("age_band", _age_source()))
def q_score_box_by_age(spark, d):
    """PRF-6: quartiles, whiskers and outliers of the risk score per age band (FE-C3)."""
    from .catalog import scored_customers
    from .prepare import q_profile_customer_features
    bands = q_profile_customer_features(spark, d).select("record_no", "age_band")
    scored = scored_customers(spark, d).select("record_no", "risk_score")
    return r6(P.box_stats(scored.join(bands, "record_no"), "risk_score", "age_band"))


# -- split and metrics ------------------------------------------------------------------------

def _hash_sql(k):
    return f"substr(md5('42|' || CAST({k} AS VARCHAR)), 1, 8)"


_LABELLED = _scored_customers_cte() + """,
lab AS (SELECT s.record_no, s.risk_score / 100.0 AS p, CASE WHEN m.unpaid_flag = '未払' THEN 1 ELSE 0 END AS label
        FROM scored s JOIN modes m ON s.record_no = m.record_no)"""


@register("stratified_split", _LABELLED + f""",
h AS (SELECT record_no, label, {_hash_sql('record_no')} AS h FROM lab)
SELECT record_no, label, h < '33333333' AS is_test,
       CASE WHEN h < '33333333' THEN 0 WHEN h < '66666666' THEN 1 WHEN h < '99999999' THEN 2
            WHEN h < 'cccccccc' THEN 3 ELSE 4 END AS fold,
       row_number() OVER (PARTITION BY label ORDER BY h, record_no)
         <= round(0.2 * count(*) OVER (PARTITION BY label)) AS is_test_exact
FROM h""")
def q_stratified_split(spark, d):
    """ML-1: deterministic hash split (20 %), five hash folds, and the
    exact-count stratified variant (first 20 % of each class in hash order)."""
    from .catalog import scored_customers
    s = scored_customers(spark, d, with_label=True).select("record_no", "label")
    return M.split_columns(s, "record_no", "label")


@register("split_balance", _LABELLED + f"""
SELECT {_hash_sql('record_no')} < '33333333' AS is_test, label, count(*) AS n FROM lab GROUP BY ALL""")
def q_split_balance(spark, d):
    """ML-1 / AGG-4: class balance of each side of the split."""
    from .catalog import scored_customers
    s = scored_customers(spark, d, with_label=True)
    return s.groupBy(H.is_test_row("record_no").alias("is_test"), "label").agg(F.count(F.lit(1)).alias("n"))


@register("random_split", with_views("calls") + f"""
SELECT {_hash_sql('contact_id')} < '33333333' AS is_test, count(*) AS n FROM calls GROUP BY ALL""")
def q_random_split(spark, d):
    """ML-2: unstratified 80/20 hash split at call grain."""
    c = AD.calls(spark, d)
    return c.groupBy(H.is_test_row("contact_id").alias("is_test")).agg(F.count(F.lit(1)).alias("n"))


@register("rule_confusion", _LABELLED + """,
cells AS (SELECT l.label, p.pred FROM (VALUES (0), (1)) l(label), (VALUES (0), (1)) p(pred)),
c AS (SELECT label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM lab GROUP BY ALL)
SELECT cells.label, cells.pred, coalesce(c.n, 0) AS n FROM cells LEFT JOIN c USING (label, pred)""")
def q_rule_confusion(spark, d):
    """MET-3: 2 x 2 confusion matrix of the rule probability at 0.5 (zero-filled)."""
    from .catalog import scored_customers
    s = scored_customers(spark, d, with_label=True).withColumn("p", F.col("risk_score") / 100.0)
    return M.confusion(M.predict_at(s, "p"))


def _report_sql():
    return _LABELLED + """,
c AS (SELECT label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM lab),
k AS (SELECT cls,
        CAST(count_if(pred = cls AND label = cls) AS DOUBLE) AS tp,
        CAST(count_if(pred = cls) AS DOUBLE) AS predicted,
        CAST(count_if(label = cls) AS DOUBLE) AS support
      FROM c, (VALUES (0), (1)) v(cls) GROUP BY cls),
m AS (SELECT cls, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, support FROM k),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
      FROM m),
rows AS (
  SELECT CAST(cls AS VARCHAR) AS class, precision, recall, f1, support FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) FROM c),
                   (SELECT count(*) FROM c))
SELECT class, round(precision * (1 + 1e-12), 6) + 0.0 AS precision, round(recall * (1 + 1e-12), 6) + 0.0 AS recall,
       round(f1 * (1 + 1e-12), 6) + 0.0 AS f1, CAST(support AS BIGINT) AS support FROM rows"""


@register("rule_report", _report_sql())
def q_rule_report(spark, d):
    """MET-1 / MET-4 / MET-5: per-class precision, recall, F1, support, macro
    and weighted averages, and accuracy (0 where undefined)."""
    from .catalog import scored_customers
    s = scored_customers(spark, d, with_label=True).withColumn("p", F.col("risk_score") / 100.0)
    return r6(M.classification_report(M.predict_at(s, "p")))


@register("rule_auc", _LABELLED + """,
g AS (SELECT p, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM lab GROUP BY p),
r AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS below FROM g)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) * (1 + 1e-12), 6) + 0.0 AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM r""")
def q_rule_auc(spark, d):
    """MET-2: exact ROC-AUC of the rule probability (ties count half)."""
    from .catalog import scored_customers
    s = scored_customers(spark, d, with_label=True).withColumn("p", F.col("risk_score") / 100.0)
    return r6(auc_from_scores(s, "label", "p"))


@register("rule_roc", _LABELLED + """,
g AS (SELECT p AS threshold, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM lab GROUP BY p)
SELECT threshold, round(sum(pos) OVER w / sum(pos) OVER () * (1 + 1e-12), 6) + 0.0 AS tpr,
       round(sum(neg) OVER w / sum(neg) OVER () * (1 + 1e-12), 6) + 0.0 AS fpr
FROM g WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_rule_roc(spark, d):
    """MET-6: ROC points (tpr, fpr) at every distinct probability."""
    from .catalog import scored_customers
    s = scored_customers(spark, d, with_label=True).withColumn("p", F.col("risk_score") / 100.0)
    return r6(roc_points(s, "label", "p"))
