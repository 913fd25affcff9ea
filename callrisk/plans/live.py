"""Batch twins of the live call-session operators (ST-1, ST-2, ST-5..8,
ST-10), each with its DuckDB oracle.  The streaming versions run the same
rules in ``callrisk.streaming`` and are checked against these twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sessions as SE
from ..sources import adapters as AD
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


def _sessions_cte(at: str | None) -> str:
    where = f"WHERE ts <= TIMESTAMP '{at}'" if at else ""
    return with_views("snapshots", "crm") + f""",
ev AS (SELECT *, CAST(sum(CASE WHEN kind = 'START' THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_no FROM snapshots {where}),
fe AS (SELECT call_id, session_no, ts AS end_ts, event_id AS end_id FROM (SELECT call_id, session_no, ts, event_id,
         row_number() OVER (PARTITION BY call_id, session_no ORDER BY ts, event_id) AS rn
         FROM ev WHERE kind = 'END' AND session_no >= 1) WHERE rn = 1),
cl AS (SELECT e.*, CASE WHEN e.kind = 'START' THEN 'OPENED'
         WHEN e.kind = 'SEGMENT' AND e.session_no >= 1 AND (fe.end_ts IS NULL OR e.ts < fe.end_ts
              OR (e.ts = fe.end_ts AND e.event_id < fe.end_id)) THEN 'SCORED'
         WHEN e.kind = 'END' AND e.session_no >= 1 AND e.event_id = fe.end_id THEN 'CLOSED'
         ELSE 'REJECTED' END AS outcome
       FROM ev e LEFT JOIN fe ON e.call_id = fe.call_id AND e.session_no = fe.session_no),
sc AS (SELECT cl.*, round_even({_RULE.format(s='cl.customer_sentiment', b='k.account_balance', f='k.risk_factors')}, 2)
         AS risk_score FROM cl LEFT JOIN crm k ON cl.call_id = k.customer_id WHERE outcome = 'SCORED'),
st AS (SELECT call_id, session_no, ts AS started_at, agent_id FROM cl WHERE outcome = 'OPENED'),
en AS (SELECT call_id, session_no, ts AS ended_at FROM cl WHERE outcome = 'CLOSED'),
lastno AS (SELECT call_id, max(session_no) AS last_session FROM st GROUP BY call_id),
ss AS (SELECT st.*, en.ended_at, CASE WHEN en.ended_at IS NOT NULL THEN 'ENDED'
                 WHEN st.session_no < l.last_session THEN 'REPLACED' ELSE 'ACTIVE' END AS status
       FROM st LEFT JOIN en USING (call_id, session_no) JOIN lastno l USING (call_id))"""


@register("session_events", _sessions_cte(None) + """
SELECT event_id, call_id, session_no, outcome FROM cl""")
def q_session_events(spark, d):
    """ST-1: every live event classified as OPENED / SCORED / CLOSED / REJECTED."""
    return SE.classify_events(AD.snapshots(spark, d)).select(
        "event_id", "call_id", F.col("session_no"), "outcome")


@register("call_sessions", _sessions_cte(None) + """,
agg AS (SELECT call_id, session_no, count(*) AS n, arg_max(risk_score, (epoch_us(ts), event_id)) AS final_score,
               avg(risk_score) AS mean_score FROM sc GROUP BY call_id, session_no)
SELECT ss.call_id, ss.session_no, ss.started_at, ss.agent_id, ss.ended_at, ss.status,
       round(((epoch_us(ss.ended_at) - epoch_us(ss.started_at)) / 1e6) * (1 + 1e-12), 6) + 0.0 AS duration_s,
       coalesce(agg.n, 0) AS n_scores, round(agg.final_score * (1 + 1e-12), 6) + 0.0 AS final_score,
       round(agg.mean_score * (1 + 1e-12), 6) + 0.0 AS mean_score
FROM ss LEFT JOIN agg USING (call_id, session_no)""")
def q_call_sessions(spark, d):
    """ST-1 / ST-5: one summary per call session (status, duration in total
    seconds, number of scores, final and mean score)."""
    return r6(SE.session_summaries(AD.snapshots(spark, d), AD.crm(spark, d)))


@register("periodic_rescoring", _sessions_cte(None) + """,
w AS (SELECT sc.*, make_timestamp(CAST((floor(epoch_us(ts) / 10000000) + 1) * 10000000 AS BIGINT)) AS window_end
      FROM sc),
l AS (SELECT call_id, session_no, window_end, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id,
             arg_max(risk_score, (epoch_us(ts), event_id)) AS risk_score FROM w GROUP BY ALL)
SELECT l.call_id, l.session_no, l.window_end, l.event_id, round(l.risk_score * (1 + 1e-12), 6) + 0.0 AS risk_score
FROM l JOIN st USING (call_id, session_no)
WHERE (epoch_us(l.window_end) - epoch_us(st.started_at)) / 1e6 > 30""")
def q_periodic_rescoring(spark, d):
    """ST-2: the latest scored snapshot of each session per 10-second window,
    once the session is older than 30 seconds."""
    return r6(SE.periodic_rescoring(AD.snapshots(spark, d), AD.crm(spark, d)))


@register("contact_attributes", _sessions_cte(REF_TIME) + f"""
SELECT call_id, session_no,
       round(((epoch_us(TIMESTAMP '{REF_TIME}') - epoch_us(started_at)) / 1e6) * (1 + 1e-12), 6) + 0.0 AS queue_time,
       round(((epoch_us(TIMESTAMP '{REF_TIME}') - epoch_us(started_at)) / 1e6) * (1 + 1e-12), 6) + 0.0 AS talk_time,
       0 AS hold_time, true AS agent_connected, true AS customer_connected
FROM ss WHERE status = 'ACTIVE'""")
def q_contact_attributes(spark, d):
    """ST-6: attributes of every session open at the reference time."""
    return r6(SE.contact_attributes(AD.snapshots(spark, d), REF_TIME))


@register("agent_presence", with_views("snapshots") + f"""
SELECT agent_id, arg_max(kind, (epoch_us(ts), event_id)) = 'START' AS active, max(ts) AS last_seen
FROM snapshots WHERE kind IN ('START', 'END') AND ts <= TIMESTAMP '{REF_TIME}' GROUP BY agent_id""")
def q_agent_presence(spark, d):
    """ST-7: agents present at the reference time (last join/leave decides)."""
    return SE.agent_presence(AD.snapshots(spark, d), REF_TIME)


@register("score_cache", _sessions_cte(REF_TIME) + f"""
SELECT call_id, arg_max(session_no, (epoch_us(ts), event_id)) AS session_no, max(ts) AS scored_at,
       round(arg_max(risk_score, (epoch_us(ts), event_id)) * (1 + 1e-12), 6) + 0.0 AS risk_score
FROM sc WHERE ts > TIMESTAMP '{REF_TIME}' - INTERVAL 3600 SECOND GROUP BY call_id""")
def q_score_cache(spark, d):
    """ST-8: latest score of each call still within the one-hour cache TTL."""
    return r6(SE.score_cache(AD.snapshots(spark, d), AD.crm(spark, d), REF_TIME))


@register("debounced_events", with_views("snapshots") + """
SELECT call_id, event_id, ts, kind FROM (
  SELECT call_id, event_id, ts, kind, lead(ts) OVER (PARTITION BY call_id ORDER BY ts, event_id) AS next_ts
  FROM snapshots)
WHERE next_ts IS NULL OR (epoch_us(next_ts) - epoch_us(ts)) / 1000.0 >= 500""")
def q_debounced_events(spark, d):
    """ST-10: last event of every burst (next event of the call 500 ms or more later)."""
    return SE.debounce(AD.snapshots(spark, d))


@register("recent_scores", _sessions_cte(None) + """
SELECT call_id, event_id, ts, round(risk_score * (1 + 1e-12), 6) + 0.0 AS risk_score, pos FROM (
  SELECT call_id, event_id, ts, risk_score,
         row_number() OVER (PARTITION BY call_id ORDER BY ts DESC, event_id DESC) AS pos FROM sc)
WHERE pos <= 10""")
def q_recent_scores(spark, d):
    """TOP-4 (score widget): the last ten scores pushed for each call, pos 1 = newest."""
    sc = SE.scored_events(SE.classify_events(AD.snapshots(spark, d)), AD.crm(spark, d))
    newest = Window.partitionBy("call_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    r = sc.withColumn("pos", F.row_number().over(newest)).filter(F.col("pos") <= 10)
    return r6(r.select("call_id", "event_id", "ts", "risk_score", "pos"))


@register("attribute_updates", _sessions_cte(None) + """
SELECT c.call_id, c.session_no, c.event_id, c.ts AS as_of,
       round(((epoch_us(c.ts) - epoch_us(st.started_at)) / 1e6) * (1 + 1e-12), 6) + 0.0 AS queue_time,
       round(((epoch_us(c.ts) - epoch_us(st.started_at)) / 1e6) * (1 + 1e-12), 6) + 0.0 AS talk_time,
       0 AS hold_time
FROM cl c JOIN st USING (call_id, session_no) WHERE c.outcome = 'SCORED'""")
def q_attribute_updates(spark, d):
    """ST-6: contact attributes refreshed on every live update of an open call."""
    return r6(SE.attribute_updates(AD.snapshots(spark, d)))


_TICKS_SINCE, _TICKS_UNTIL = "2024-01-15 11:59:00", REF_TIME


@register("attribute_ticks", _sessions_cte(None) + f""",
span AS (SELECT ss.call_id, ss.session_no, ss.started_at, epoch_us(ss.started_at) AS a,
                least(coalesce(epoch_us(ss.ended_at), epoch_us(TIMESTAMP '{_TICKS_UNTIL}')),
                      coalesce(epoch_us(nx.started_at), epoch_us(TIMESTAMP '{_TICKS_UNTIL}')),
                      epoch_us(TIMESTAMP '{_TICKS_UNTIL}')) AS b
         FROM ss LEFT JOIN ss nx ON ss.call_id = nx.call_id AND ss.session_no + 1 = nx.session_no),
tick AS (SELECT *, a + 5000000 * unnest(range(
             greatest(CAST(ceil((epoch_us(TIMESTAMP '{_TICKS_SINCE}') - a) / 5000000) AS BIGINT), 0),
             CAST(ceil((b - a) / 5000000) AS BIGINT))) AS t FROM span)
SELECT call_id, session_no, make_timestamp(t) AS as_of, round(((t - a) / 1e6) * (1 + 1e-12), 6) + 0.0 AS queue_time,
       round(((t - a) / 1e6) * (1 + 1e-12), 6) + 0.0 AS talk_time, 0 AS hold_time, true AS agent_connected,
       true AS customer_connected FROM tick""")
def q_attribute_ticks(spark, d):
    """ST-6: contact attributes of every open call every five seconds, in the minute before the reference time."""
    return r6(SE.attribute_ticks(AD.snapshots(spark, d), _TICKS_SINCE, _TICKS_UNTIL))
