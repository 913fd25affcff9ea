"""Structured Streaming operators of the live path (ST-1..4, ST-9, SNK-11).

* ``live_stream``: the call-session state machine (``calls.LiveCalls``, keyed by ``call_id``),
  whose rows feed ``session_stream`` (ST-1 / ST-5), ``rescoring_stream`` (ST-2),
  ``score_cache_stream`` (ST-8), ``attribute_stream`` and ``attribute_tick_stream`` (ST-6),
  ``gauge_stream`` (AGG-10) and ``live_results`` (PL-6).  Events are taken in event-time
  order behind the watermark.
* ``trigger_stream``: stateless parse + filter of contact events (ST-9).
* ``latest_view_stream``: latest segment / count / span per contact (ST-4).

The batch twins in ``callrisk.operators.sessions`` compute the same rows from
a table; the tests run each stream with ``availableNow`` and compare.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema as S
from ..functions.scalar import elapsed_seconds
from ..operators.rules import agent_recommendations, realtime_band, risk_factors, rule_score
from ..operators.transcripts import transcript_view
from ..sources.events import contact_triggers
from .calls import GAUGES, OUTPUT, LiveCalls, LiveGauges


def score_events(stream: DataFrame, crm: DataFrame) -> DataFrame:
    """Stream-static join to the CRM and the live rule score per event.  The
    static side is re-read per micro-batch; adaptive execution broadcasts it
    only under the size threshold."""
    k = crm.select("customer_id", "account_balance", "risk_factors")
    j = stream.join(k, stream.call_id == k.customer_id, "left")
    return j.withColumn("risk_score", F.bround(rule_score(), 2))


def live_stream(scored: DataFrame, watermark: str = "1 hour", timeout_ms: int = 4 * 3_600_000,
                keep_ms: int = 24 * 3_600_000, period_s: int = 10, min_age_s: int = S.RESCORE_MIN_AGE_SECONDS,
                ttl_s: int | None = S.SCORE_CACHE_TTL_SECONDS, refresh_s: int | None = None,
                chained: bool = False) -> DataFrame:
    """The live state machine (ST-1, ST-2, ST-5, ST-6, ST-8; ``calls.LiveCalls``) over scored events (``score_events``).

    Events wait in the state until the watermark has passed them, so a late start inside the
    watermark still opens its session, and are then taken in (time, id) order.  State per call: a
    few numbers, the events inside the watermark's lag and the open 10-second windows; an open
    session without events is closed after ``timeout_ms``, and a call is forgotten ``keep_ms`` after
    its last event.  With ``refresh_s`` every open session also gives a row at its start and every so
    many seconds after it.  ``chained``: other stateful operators may follow, for which ``ts`` stays the event
    time; then no cached scores expire (such rows would be older than the watermark).
    """
    rows = (scored.withWatermark("ts", watermark)
            .select("call_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "kind", "agent_id", "customer_sentiment",
                    "risk_score")
            .groupBy("call_id")
            .transformWithState(LiveCalls(timeout_ms, keep_ms, period_s, min_age_s, None if chained else ttl_s, refresh_s),
                                OUTPUT, "append", "eventtime", eventTimeColumnName="ts" if chained else ""))
    return rows.select("call_id", "session_no", "event_id", "ts", "outcome", "agent_id",
                       F.timestamp_micros("started_us").alias("started_at"), "customer_sentiment", "risk_score",
                       "n_scores", "final_score", "mean_score")


def session_stream(scored: DataFrame, watermark: str = "1 hour", timeout_ms: int = 4 * 3_600_000, **kw) -> DataFrame:
    """ST-1 / ST-5: a summary for each session that ended, was replaced or timed out."""
    over = live_stream(scored, watermark, timeout_ms, **kw).filter(F.col("outcome").isin("ENDED", "REPLACED", "TIMED_OUT"))
    ended = F.when(F.col("outcome") == "ENDED", F.col("ts"))
    return over.select("call_id", "session_no", "started_at", "agent_id", ended.alias("ended_at"),
                       F.col("outcome").alias("status"), elapsed_seconds(ended, F.col("started_at")).alias("duration_s"),
                       "n_scores", "final_score", "mean_score")


def live_results(scored: DataFrame, crm: DataFrame, **kw) -> DataFrame:
    """PL-6 / SC-16: every live message: call opened, scored (score, band, confidence, recommendations and
    factors), closed, session over with its summary, and rejected events with their error."""
    rows = live_stream(scored, **kw).filter(~F.col("outcome").isin("RESCORED", "EXPIRED", "REFRESHED"))
    k = crm.select("customer_id", "account_balance", "risk_factors")
    j = rows.join(k, rows.call_id == k.customer_id, "left")
    is_scored = F.col("outcome") == "SCORED"
    score = F.col("risk_score")
    return j.select(
        "call_id", "session_no", "event_id", "ts", "outcome", "agent_id", "started_at", "risk_score",
        F.when(is_scored, realtime_band(score)).alias("risk_category"),
        F.when(is_scored, F.lit(S.RULE_CONFIDENCE)).alias("confidence"),
        F.when(is_scored, agent_recommendations(score)).alias("recommendations"),
        F.when(is_scored, risk_factors()).alias("factors"),
        F.when(F.col("outcome") == "REJECTED", F.lit("Call not found")).alias("error"),
        "n_scores", "final_score", "mean_score")


def trigger_stream(raw_events: DataFrame) -> DataFrame:
    """ST-9: the contact-event trigger filter on a stream of JSON texts."""
    return contact_triggers(raw_events)


def rescoring_stream(scored: DataFrame, **kw) -> DataFrame:
    """ST-2: the latest score of each session per 10-second window, once the session is older than 30 s;
    a window comes when the watermark has passed its end."""
    return live_stream(scored, **kw).filter(F.col("outcome") == "RESCORED").select(
        "call_id", "session_no", F.col("ts").alias("window_end"), "event_id", "risk_score")


def latest_view_stream(segments: DataFrame) -> DataFrame:
    """ST-4: latest segment, buffered count and seconds since the first segment per contact (update mode)."""
    return transcript_view(segments)


def checkpoint_location(spark, name: str) -> str:
    """Stream checkpoints live under the shared ``spark.checkpoint.dir``, so a
    restarted query (or a lost executor) resumes from the committed offsets."""
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/streams/{name}"


BUFFER_SCHEMA = ("contact_id long, segment_count long, latest_segment_id long, first_customer_neg double, "
                 "last_customer_pos double, n_customer long")
BUFFER_STATE = "segment_ids array<long>, speakers array<string>, neg array<double>, pos array<double>"


BUFFER_FIELDS = ["segment_id", "speaker", "negative_score", "positive_score"]


def _buffer_fn(n: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(dict(zip(BUFFER_FIELDS, state.get if state.exists else ([], [], [], []))))
        for pdf in pdfs:                                  # never more than one Arrow batch beside the newest n
            newest = pdf[BUFFER_FIELDS].nlargest(n, "segment_id")
            kept = (pd.concat([kept, newest]) if len(kept) else newest).nlargest(n, "segment_id")
        kept = kept.sort_values("segment_id", kind="stable")
        state.update(([int(i) for i in kept["segment_id"]], kept["speaker"].tolist(),
                      [float(x) for x in kept["negative_score"]], [float(x) for x in kept["positive_score"]]))
        cust = kept[kept["speaker"] == "CUSTOMER"]
        yield pd.DataFrame([{
            "contact_id": int(key[0]), "segment_count": len(kept),
            "latest_segment_id": int(kept["segment_id"].iloc[-1]) if len(kept) else None,
            "first_customer_neg": float(cust["negative_score"].iloc[0]) if len(cust) else None,
            "last_customer_pos": float(cust["positive_score"].iloc[-1]) if len(cust) else None,
            "n_customer": len(cust)}])
    return fn


def segment_buffer_stream(segments: DataFrame, n: int = 10) -> DataFrame:
    """ST-3: the last ``n`` segments of each contact as bounded list state (at
    most ``n`` entries per contact), with the buffer summary SC-14 / SC-15
    need (count, newest id, first customer negative, last customer positive);
    update mode, one row per contact per micro-batch."""
    flat = segments.select("contact_id", "segment_id", "speaker",
                           F.col("sentiment.negative_score").alias("negative_score"),
                           F.col("sentiment.positive_score").alias("positive_score"))
    return flat.groupBy("contact_id").applyInPandasWithState(
        _buffer_fn(n), BUFFER_SCHEMA, BUFFER_STATE, "update", GroupStateTimeout.NoTimeout)


def debounce_stream(events: DataFrame, gap: str = "500 milliseconds", watermark: str = "1 minute") -> DataFrame:
    """ST-10: the last event of every burst per call, as a session window with
    a 500 ms gap (a burst closes once the watermark passes its end)."""
    return (events.withWatermark("ts", watermark)
            .groupBy("call_id", F.session_window("ts", gap).alias("s"))
            .agg(F.max_by(F.struct("event_id", "ts", "kind"), F.struct("ts", "event_id")).alias("l"))
            .select("call_id", F.col("l.event_id").alias("event_id"), F.col("l.ts").alias("ts"),
                    F.col("l.kind").alias("kind")))


def presence_stream(events: DataFrame) -> DataFrame:
    """ST-7: an agent joins with a call start and leaves with a call end; the
    latest such event decides presence (update mode, one row per agent)."""
    ctl = events.filter(F.col("kind").isin("START", "END"))
    return ctl.groupBy("agent_id").agg(
        (F.max_by("kind", F.struct("ts", "event_id")) == "START").alias("active"),
        F.max("ts").alias("last_seen"))


def score_cache_stream(scored: DataFrame, **kw) -> DataFrame:
    """ST-8: the score cache as a change log: each accepted score enters the cache of its call
    (``cached = true``) and leaves it one hour of event time after the last one (``cached = false``)."""
    rows = live_stream(scored, **kw).filter(F.col("outcome").isin("SCORED", "EXPIRED"))
    return rows.select("call_id", "session_no", "event_id", F.col("ts").alias("scored_at"), "risk_score",
                       (F.col("outcome") == "SCORED").alias("cached"))


def attribute_stream(scored: DataFrame, **kw) -> DataFrame:
    """ST-6: contact attributes on every accepted live update of an open call."""
    rows = live_stream(scored, **kw).filter(F.col("outcome") == "SCORED")
    secs = elapsed_seconds("ts", "started_at")
    return rows.select("call_id", "session_no", "event_id", F.col("ts").alias("as_of"), secs.alias("queue_time"),
                       secs.alias("talk_time"), F.lit(0).alias("hold_time"))


def attribute_tick_stream(scored: DataFrame, refresh_s: int = S.ATTRIBUTE_REFRESH_SECONDS, **kw) -> DataFrame:
    """ST-6: contact attributes of every open call at its start and every ``refresh_s`` seconds after it, as the
    watermark passes these instants; timers give the rows, no event is needed."""
    rows = live_stream(scored, refresh_s=refresh_s, **kw).filter(F.col("outcome") == "REFRESHED")
    secs = elapsed_seconds("ts", "started_at")
    return rows.select("call_id", "session_no", F.col("ts").alias("as_of"), secs.alias("queue_time"), secs.alias("talk_time"),
                       F.lit(0).alias("hold_time"), F.lit(True).alias("agent_connected"),
                       F.lit(True).alias("customer_connected"))


def gauge_stream(scored: DataFrame, shards: int = 32, **kw) -> DataFrame:
    """AGG-10: active calls and agents per shard of agents, a row whenever sessions of the shard open or close.
    The counters follow the state machine in the same query; ``gauge_totals`` adds the shards up."""
    rows = live_stream(scored, chained=True, **kw) \
        .filter(F.col("outcome").isin("OPENED", "ENDED", "REPLACED", "TIMED_OUT"))
    shard = F.pmod(F.xxhash64("agent_id"), F.lit(shards)).cast("int")
    return (rows.select(shard.alias("shard"), "ts", "outcome", "agent_id").groupBy("shard")
            .transformWithState(LiveGauges(), GAUGES, "append", "eventtime"))


def gauge_totals(changes: DataFrame) -> DataFrame:
    """The gauges now, from the rows that ``gauge_stream`` has given: the newest of each shard, added up."""
    newest = changes.groupBy("shard").agg(F.max_by(F.struct("active_calls", "active_agents"), "ts").alias("g"))
    return newest.agg(F.coalesce(F.sum("g.active_calls"), F.lit(0)).alias("active_calls"),
                      F.coalesce(F.sum("g.active_agents"), F.lit(0)).alias("active_agents"))
