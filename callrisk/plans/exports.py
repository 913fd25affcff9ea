"""Queries behind the sinks that carry data logic: the CRM upsert (SNK-8) and
the run summary KPI row (SNK-6 / AGG-9), each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.ranking import auc_from_scores
from ..operators import metrics as M
from ..operators import rules as R
from ..sinks import writers as W
from ..sources import adapters as AD
from ..sources import events as EV
from .common import REF_TIME, r6
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


_RULE = ("CAST(greatest(0.0, least(100.0, 50.0"
         " + CASE WHEN coalesce({s}, 0) < -0.5 THEN 20.0 WHEN coalesce({s}, 0) < 0 THEN 10.0 ELSE 0.0 END"
         " + CASE WHEN coalesce({b}, 0) < 5000 THEN 15.0 WHEN coalesce({b}, 0) > 30000 THEN -10.0 ELSE 0.0 END"
         " + coalesce(len({f}), 0) * 5.0)) AS DOUBLE)")


def _upsert_sql():
    lv = "CASE WHEN rule >= 70 THEN 'high' WHEN rule >= 40 THEN 'medium' ELSE 'low' END"
    rec = " ".join(f"WHEN '{k}' THEN '{chr(10).join(v)}'" for k, v in S.AGENT_RECOMMENDATIONS.items())
    return with_views("snapshots", "crm") + f""",
live AS (SELECT s.*, k.customer_id, k.account_balance, k.risk_factors,
                {_RULE.format(s='s.customer_sentiment', b='k.account_balance', f='k.risk_factors')} AS rule
         FROM snapshots s JOIN crm k ON s.call_id = k.customer_id WHERE s.kind = 'SEGMENT'),
upd AS (SELECT customer_id, round_even(rule, 2) AS risk_score,
               CASE WHEN rule >= 70 THEN '高リスク' WHEN rule >= 40 THEN '中リスク' ELSE '低リスク' END AS risk_level,
               ts AS risk_updated_at, event_id,
               array_to_string(list_filter([
                 CASE WHEN coalesce(customer_sentiment, 0) < -0.3 THEN '{S.RISK_FACTOR_NEGATIVE_SENTIMENT}' END,
                 CASE WHEN coalesce(account_balance, 0) < 5000 THEN '{S.RISK_FACTOR_LOW_BALANCE}' END,
                 CASE WHEN coalesce(len(risk_factors), 0) > 2 THEN '{S.RISK_FACTOR_MANY_PAST}' END],
                 lambda x: x IS NOT NULL), ', ') AS risk_factors_text,
               (CASE {lv} {rec} END) || CASE WHEN coalesce(customer_sentiment, 0) < -0.3
                 THEN '{chr(10)}{S.AGENT_UNHAPPY_RECOMMENDATION}' ELSE '' END AS recommendations_text
        FROM live),
cur AS (SELECT customer_id, CAST(NULL AS DOUBLE) AS risk_score, CAST(NULL AS VARCHAR) AS risk_level,
               CAST(NULL AS TIMESTAMP) AS risk_updated_at, CAST(NULL AS BIGINT) AS event_id, '' AS risk_factors_text, '' AS recommendations_text
        FROM crm),
allr AS (SELECT * FROM cur UNION ALL SELECT * FROM upd)
SELECT customer_id, round(risk_score * (1 + 1e-12), 6) + 0.0 AS risk_score, risk_level, risk_updated_at,
       risk_factors_text, recommendations_text
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
                                    ORDER BY risk_updated_at DESC NULLS LAST, event_id DESC NULLS LAST) AS rn FROM allr)
WHERE rn = 1"""


@register("crm_upsert", _upsert_sql())
def q_crm_upsert(spark, d):
    """SNK-8: every live score written back to the CRM, latest per customer
    wins; factors joined with ', ', recommendations with newlines."""
    crm = AD.crm(spark, d)
    live = EV.lookup_customers(AD.snapshots(spark, d), crm, "call_id") \
        .filter((F.col("kind") == "SEGMENT") & F.col("found"))
    res = R.score_live(live).select(
        "customer_id", "risk_score", F.col("risk_category").alias("risk_level"),
        F.col("ts").alias("risk_updated_at"), "event_id", "factors", "recommendations")
    updates = W.risk_update_record(res)
    current = crm.select("customer_id", F.lit(None).cast("double").alias("risk_score"),
                         F.lit(None).cast("string").alias("risk_level"),
                         F.lit(None).cast("timestamp").alias("risk_updated_at"),
                         F.lit("").alias("risk_factors_text"), F.lit("").alias("recommendations_text"))
    return r6(W.crm_upsert(current, updates))


def _summary_sql():
    from .scoring import _LABELLED
    return _LABELLED + f""",
c AS (SELECT label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred, p FROM lab),
k AS (SELECT cls, CAST(count_if(pred = cls AND label = cls) AS DOUBLE) AS tp,
             CAST(count_if(pred = cls) AS DOUBLE) AS pr, CAST(count_if(label = cls) AS DOUBLE) AS su
      FROM c, (VALUES (0), (1)) v(cls) GROUP BY cls),
m AS (SELECT cls, su, CASE WHEN pr = 0 THEN 0.0 ELSE tp / pr END AS pp, CASE WHEN su = 0 THEN 0.0 ELSE tp / su END AS rr
      FROM k),
f AS (SELECT *, CASE WHEN pp + rr = 0 THEN 0.0 ELSE 2 * pp * rr / (pp + rr) END AS ff FROM m),
w AS (SELECT sum(pp * su) / sum(su) AS precision, sum(rr * su) / sum(su) AS recall, sum(ff * su) / sum(su) AS f1 FROM f),
g AS (SELECT p, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM lab GROUP BY p),
r AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS below FROM g),
a AS (SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM r)
SELECT TIMESTAMP '{REF_TIME}' AS generated_at, (SELECT count(*) FROM lab) AS customers_scored,
       (SELECT count(*) FROM lab WHERE (1 - p) * 100 < 40) AS high_risk_customers,
       round((SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) FROM c) * (1 + 1e-12), 6) + 0.0 AS accuracy,
       round(a.auc * (1 + 1e-12), 6) + 0.0 AS roc_auc, round(w.precision * (1 + 1e-12), 6) + 0.0 AS precision,
       round(w.recall * (1 + 1e-12), 6) + 0.0 AS recall, round(w.f1 * (1 + 1e-12), 6) + 0.0 AS f1
FROM a, w"""


@register("summary_report", _summary_sql())
def q_summary_report(spark, d):
    """SNK-6 / AGG-9: the run's KPI row: time, customers scored, customers in
    the high-risk band, accuracy, AUC and weighted precision / recall / F1."""
    from .catalog import scored_customers
    s = scored_customers(spark, d, with_label=True).withColumn("p", F.col("risk_score") / 100.0)
    s = M.predict_at(s, "p")
    rep = M.classification_report(s)
    w = rep.filter(F.col("class") == "weighted avg").select("precision", "recall", "f1")
    acc = rep.filter(F.col("class") == "accuracy").select(F.col("f1").alias("accuracy"))
    auc = auc_from_scores(s, "label", "p").select(F.col("auc").alias("roc_auc"))
    counts = s.agg(F.count(F.lit(1)).alias("customers_scored"),
                   F.count_if(R.safety_band(R.safety_score("p")) == S.BATCH_LABELS[2]).alias("high_risk_customers"))
    # every input is one row: the joins below are single-row products on a constant key
    one = F.lit(1)
    out = (counts.withColumn("_k", one).join(acc.withColumn("_k", one), "_k").join(auc.withColumn("_k", one), "_k")
           .join(w.withColumn("_k", one), "_k").drop("_k"))
    return r6(out.select(F.lit(REF_TIME).cast("timestamp").alias("generated_at"), "customers_scored",
                         "high_risk_customers", "accuracy", "roc_auc", "precision", "recall", "f1"))


@register("customer_cards", with_views("crm") + """
SELECT customer_id, name, '¥' || format('{:,.0f}', account_balance) AS balance_text,
       CAST(previous_calls AS VARCHAR) || '回' AS previous_calls_text
FROM crm""")
def q_customer_cards(spark, d):
    """Mobile customer card fields: money with separators, call count text."""
    from ..functions import text as TX
    c = AD.crm(spark, d)
    return c.select("customer_id", "name", TX.yen("account_balance").alias("balance_text"),
                    TX.times("previous_calls").alias("previous_calls_text"))


@register("call_codes", with_views("snapshots") + """
SELECT event_id,
       'CALL-' || strftime(ts, '%Y%m%d-%H%M%S') || '-' ||
         CAST(1000 + CAST('0x' || substr(md5('42|' || CAST(call_id AS VARCHAR)), 1, 8) AS UBIGINT) % 9000 AS VARCHAR)
         AS call_code,
       strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%Y年%m月%d日') AS start_date_jst,
       strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%H時%M分') AS start_time_jst
FROM snapshots WHERE kind = 'START'""")
def q_call_codes(spark, d):
    """Call codes of every call start (deterministic digits) with the start
    date and time in Japan time."""
    from ..functions import text as TX
    s = AD.snapshots(spark, d).filter(F.col("kind") == "START")
    return s.select("event_id", TX.call_code("ts", "call_id").alias("call_code"),
                    TX.jst_date("ts").alias("start_date_jst"), TX.jst_time("ts").alias("start_time_jst"))


def _metric_display_sql():
    names = ("accuracy", "precision", "recall", "f1", "roc_auc")
    rows = [f"SELECT '{n.replace('_', ' ').title()}' AS Metric, printf('%.4f', {n}) AS Value FROM summary"
            for n in names]
    return "WITH summary AS (" + _summary_sql() + ")\n" + "\nUNION ALL ".join(rows)


@register("metric_display", _metric_display_sql())
def q_metric_display(spark, d):
    """The classification-metric table as displayed: title-cased names and
    4-digit values, for the rule model's run summary."""
    from ..functions import text as TX
    s = q_summary_report(spark, d)
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    long = s.select(F.inline(F.array(*[F.struct(F.lit(n).alias("m"), F.col(n).cast("double").alias("v"))
                                       for n in names])))
    return long.select(TX.metric_title("m").alias("Metric"), TX.fixed("v", 4).alias("Value"))
