"""Live call sessions as batch jobs (ST-1, ST-2, ST-5..8, ST-10, AGG-10).

A call's events are START / SEGMENT / END rows keyed by ``call_id``.  The
session rules are those of the live service: a START opens a session (and
replaces an open one), a SEGMENT of an open session is scored, the first END
closes it; a SEGMENT or END without an open session is rejected ("Call not
found").

Plan: ``session_no`` = running count of STARTs in (ts, event_id) order, from
the range-partitioned running-count job (a call holding a third of all
events is split over many tasks); each session's first END is a grouped
``min`` (partial aggregation); the rest are joins of per-session rows back
to events.  The streaming twin lives in ``callrisk.streaming.sessions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.ranking import next_in_order, running_count
from ..functions.scalar import elapsed_seconds
from .rules import rule_score


def _upto(events: DataFrame, at) -> DataFrame:
    return events if at is None else events.filter(F.col("ts") <= F.lit(at).cast("timestamp"))


def classify_events(events: DataFrame, at=None) -> DataFrame:
    """Every event with ``session_no`` and ``outcome``: OPENED, SCORED, CLOSED
    or REJECTED."""
    ev = _upto(events, at).withColumn("_is_start", (F.col("kind") == "START").cast("long"))
    numbered, _ = running_count(ev, ["call_id"], ["ts", "event_id"], "_is_start")
    numbered = numbered.withColumn("session_no", F.col("_cum").cast("long")).drop("_cum", "_is_start")
    ends = (numbered.filter((F.col("kind") == "END") & (F.col("session_no") >= 1))
            .groupBy("call_id", "session_no")
            .agg(F.min(F.struct("ts", "event_id")).alias("_first_end")))
    j = numbered.join(ends, ["call_id", "session_no"], "left")
    me = F.struct("ts", "event_id")
    open_ = (F.col("session_no") >= 1) & (F.col("_first_end").isNull() | (me < F.col("_first_end")))
    outcome = (F.when(F.col("kind") == "START", "OPENED")
               .when((F.col("kind") == "SEGMENT") & open_, "SCORED")
               .when((F.col("kind") == "END") & (F.col("session_no") >= 1) & (me == F.col("_first_end")), "CLOSED")
               .otherwise("REJECTED"))
    return j.withColumn("outcome", outcome).drop("_first_end")


def scored_events(classified: DataFrame, crm: DataFrame) -> DataFrame:
    """SCORED events joined to the CRM, with the live rule score."""
    seg = classified.filter(F.col("outcome") == "SCORED")
    k = crm.select("customer_id", "account_balance", "risk_factors")
    j = seg.join(k, seg.call_id == k.customer_id, "left")
    return j.withColumn("risk_score", F.bround(rule_score(), 2))


def _per_session(cl: DataFrame, scores: bool) -> DataFrame:
    """One grouped pass over the classified events: start, agent, end and (with
    ``scores``) the score count / final / mean of every session."""
    opened, closed, scored = (F.col("outcome") == o for o in ("OPENED", "CLOSED", "SCORED"))
    aggs = [F.min(F.when(opened, F.col("ts"))).alias("started_at"),
            F.max(F.when(opened, F.col("agent_id"))).alias("agent_id"),
            F.min(F.when(closed, F.col("ts"))).alias("ended_at")]
    if scores:
        aggs += [F.count_if(scored).alias("n_scores"),
                 F.max_by(F.when(scored, F.col("risk_score")), F.when(scored, F.struct("ts", "event_id")))
                 .alias("final_score"),
                 F.avg(F.when(scored, F.col("risk_score"))).alias("mean_score")]
    per = cl.filter(F.col("session_no") >= 1).groupBy("call_id", "session_no").agg(*aggs)
    last = per.groupBy("call_id").agg(F.max("session_no").alias("_last_session"))
    j = per.join(last, "call_id")
    status = (F.when(F.col("ended_at").isNotNull(), "ENDED")
              .when(F.col("session_no") < F.col("_last_session"), "REPLACED").otherwise("ACTIVE"))
    return j.withColumn("status", status).drop("_last_session")


def with_scores(classified: DataFrame, crm: DataFrame) -> DataFrame:
    """Every classified event with the live rule score on its SCORED rows."""
    k = crm.select("customer_id", "account_balance", "risk_factors")
    j = classified.join(k, classified.call_id == k.customer_id, "left")
    return j.withColumn("risk_score", F.when(F.col("outcome") == "SCORED", F.bround(rule_score(), 2)))


def session_summaries(events: DataFrame, crm: DataFrame, at=None) -> DataFrame:
    """ST-1 / ST-5: one row per session: start, agent, end, status (ENDED,
    REPLACED by a later start, or ACTIVE), duration in total seconds, number of
    scores and the final score.  The classified events are read once."""
    per = _per_session(with_scores(classify_events(events, at), crm), scores=True)
    return per.select(
        "call_id", "session_no", "started_at", "agent_id", "ended_at", "status",
        F.when(F.col("ended_at").isNotNull(), elapsed_seconds("ended_at", "started_at")).alias("duration_s"),
        "n_scores", "final_score", "mean_score")


def periodic_rescoring(events: DataFrame, crm: DataFrame, period: str = "10 seconds",
                       min_age_s: int = S.RESCORE_MIN_AGE_SECONDS) -> DataFrame:
    """ST-2: per session and 10-second window, the latest scored snapshot, kept
    when the session is older than 30 s at the window end."""
    cl = classify_events(events)
    sc = scored_events(cl, crm)
    starts = cl.filter(F.col("outcome") == "OPENED").select("call_id", "session_no", F.col("ts").alias("started_at"))
    g = sc.groupBy("call_id", "session_no", F.window("ts", period).alias("w")).agg(
        F.max_by(F.struct("event_id", "risk_score"), F.struct("ts", "event_id")).alias("l"))
    j = g.join(starts, ["call_id", "session_no"])
    return (j.filter(elapsed_seconds(F.col("w.end"), F.col("started_at")) > min_age_s)
            .select("call_id", "session_no", F.col("w.end").alias("window_end"),
                    F.col("l.event_id").alias("event_id"), F.col("l.risk_score").alias("risk_score")))


def contact_attributes(events: DataFrame, at: str) -> DataFrame:
    """ST-6: attributes of each session open at ``at``: queue and talk time in
    total seconds since the start, no hold time, both sides connected."""
    s = session_states(events, at)
    act = s.filter(F.col("status") == "ACTIVE")
    secs = elapsed_seconds(F.lit(at).cast("timestamp"), F.col("started_at"))
    return act.select("call_id", "session_no", secs.alias("queue_time"), secs.alias("talk_time"),
                      F.lit(0).alias("hold_time"), F.lit(True).alias("agent_connected"),
                      F.lit(True).alias("customer_connected"))


def attribute_updates(events: DataFrame) -> DataFrame:
    """ST-6 (per update): on every accepted live update of an open session, the
    contact attributes at that instant: queue and talk time in total seconds
    since the session start, no hold time, both sides connected."""
    cl = classify_events(events)
    per = _per_session(cl, scores=False).select("call_id", "session_no", "started_at")
    upd = cl.filter(F.col("outcome") == "SCORED").select("call_id", "session_no", "event_id", "ts")
    j = upd.join(per, ["call_id", "session_no"])
    secs = elapsed_seconds("ts", "started_at")
    return j.select("call_id", "session_no", "event_id", F.col("ts").alias("as_of"), secs.alias("queue_time"),
                    secs.alias("talk_time"), F.lit(0).alias("hold_time"))


def attribute_ticks(events: DataFrame, since: str, until: str, every_s: int = S.ATTRIBUTE_REFRESH_SECONDS) -> DataFrame:
    """ST-6 (periodic): the contact attributes of every session at its start and every ``every_s`` seconds after
    it while it is open, for the instants in [since, until): queue and talk time in total seconds since the
    start, no hold time, both sides connected.  A session is open until its end or the next start of its call."""
    per = _per_session(classify_events(events), scores=False)
    after = per.select("call_id", (F.col("session_no") - 1).alias("session_no"), F.col("started_at").alias("_next"))
    over = F.least(F.coalesce("ended_at", F.lit(until).cast("timestamp")), F.coalesce("_next", F.lit(until).cast("timestamp")),
                   F.lit(until).cast("timestamp"))
    spans = per.join(after, ["call_id", "session_no"], "left").select(
        "call_id", "session_no", "started_at", F.unix_micros("started_at").alias("_a"), F.unix_micros(over).alias("_b"))
    step = every_s * 1_000_000
    first = F.greatest(F.ceil((F.unix_micros(F.lit(since).cast("timestamp")) - F.col("_a")) / step), F.lit(0))
    last = F.ceil((F.col("_b") - F.col("_a")) / step) - 1
    ticks = spans.select("call_id", "session_no", "started_at", "_a", first.alias("_k"), last.alias("_l")) \
        .filter("_k <= _l").select("call_id", "session_no", "started_at", "_a", F.explode(F.sequence("_k", "_l")).alias("_n"))
    at = F.timestamp_micros(F.col("_a") + F.col("_n") * step)
    secs = elapsed_seconds("as_of", "started_at")
    return ticks.select("call_id", "session_no", "started_at", at.alias("as_of")).select(
        "call_id", "session_no", "as_of", secs.alias("queue_time"), secs.alias("talk_time"), F.lit(0).alias("hold_time"),
        F.lit(True).alias("agent_connected"), F.lit(True).alias("customer_connected"))


def session_states(events: DataFrame, at) -> DataFrame:
    """Session rows without scores (start, end, status) as of ``at``."""
    return _per_session(classify_events(events, at), scores=False).select(
        "call_id", "session_no", "started_at", "agent_id", "ended_at", "status")


def agent_presence(events: DataFrame, at: str) -> DataFrame:
    """ST-7: an agent joins with a call start and leaves with a call end; the
    last such event by ``at`` decides whether the agent is present."""
    ctl = _upto(events, at).filter(F.col("kind").isin("START", "END"))
    g = ctl.groupBy("agent_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("_k"),
                                    F.max("ts").alias("last_seen"))
    return g.select("agent_id", (F.col("_k") == "START").alias("active"), "last_seen")


def score_cache(events: DataFrame, crm: DataFrame, at: str, ttl_s: int = S.SCORE_CACHE_TTL_SECONDS) -> DataFrame:
    """ST-8: latest score per call still alive in a cache with a 1 h time-to-live."""
    sc = scored_events(classify_events(events, at), crm)
    lo = F.lit(at).cast("timestamp") - F.expr(f"INTERVAL {int(ttl_s)} SECONDS")
    live = sc.filter(F.col("ts") > lo)
    return live.groupBy("call_id").agg(
        F.max_by(F.struct("ts", "risk_score", "session_no"), F.struct("ts", "event_id")).alias("l")
    ).select("call_id", F.col("l.session_no").alias("session_no"), F.col("l.ts").alias("scored_at"),
             F.col("l.risk_score").alias("risk_score"))


def debounce(events: DataFrame, key: str = "call_id", gap_ms: int = S.DEBOUNCE_MILLISECONDS) -> DataFrame:
    """ST-10: keep the last event of each burst: an event is dropped when the
    next event of its key follows less than ``gap_ms`` later (the session-window
    rule of the streaming form, whose window of an event ends ``gap`` after it)."""
    nx = next_in_order(events.select(key, "event_id", "ts", "kind"), [key], ["ts", "event_id"], ["ts"])
    gap = (F.unix_micros("next_ts") - F.unix_micros("ts")) / 1000.0
    return nx.filter(F.col("next_ts").isNull() | (gap >= gap_ms)).drop("next_ts")
