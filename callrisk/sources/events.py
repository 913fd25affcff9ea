"""Record-level sources of the live path: CRM lookup and flattening, call
history, contact-event parsing and session state (SRC-2, SRC-4..6, SRC-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.ranking import rank_within


def require_columns(df: DataFrame, cols) -> DataFrame:
    """SRC-2: fail loudly (no synthetic fallback) when a required column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df


def lookup_customers(calls: DataFrame, crm: DataFrame, key: str) -> DataFrame:
    """SRC-4 / JN-1: left join of calls to the CRM with a ``found`` flag.

    The CRM has one row per customer and grows with the customer base, so the
    join is not forced to broadcast: adaptive execution broadcasts it only
    when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``
    and otherwise shuffles both sides on the key (skew join splits a hot key).
    """
    k = crm.withColumn("found", F.lit(True))
    j = calls.join(k, calls[key] == k["customer_id"], "left")
    return j.withColumn("found", F.coalesce(F.col("found"), F.lit(False)))


def crm_records_json(crm: DataFrame) -> DataFrame:
    """The CRM in its raw wire form: one JSON text per customer where every
    field is ``{"value": ...}`` (numbers as text, lists as lists)."""
    def v(c):
        return F.struct(c.alias("value"))
    rec = F.struct(
        v(F.col("customer_id").cast("string")).alias("customer_id"),
        v(F.col("name")).alias("name"),
        v(F.col("account_balance").cast("string")).alias("account_balance"),
        v(F.col("risk_factors")).alias("risk_factors"),
        v(F.col("previous_calls").cast("string")).alias("previous_calls"),
        v(F.col("satisfaction_score").cast("string")).alias("satisfaction_score"),
    )
    return crm.select(F.to_json(rec).alias("record"))


def flatten_crm_records(raw: DataFrame, col: str = "record") -> DataFrame:
    """SRC-5: parse ``{field: {"value": v}}`` records; absent fields default to
    '' / 0 / [] and numbers are coerced (bad text -> default)."""
    r = F.from_json(F.col(col), S.CRM_RECORD_SCHEMA)
    p = raw.select(r.alias("r"))

    def val(name):
        return F.col("r").getField(name).getField("value")
    empty = F.array().cast("array<string>")
    return p.select(
        F.coalesce(val("customer_id"), F.lit("")).alias("customer_id"),
        F.coalesce(val("name"), F.lit("")).alias("name"),
        F.coalesce(val("phone"), F.lit("")).alias("phone"),
        F.coalesce(val("email"), F.lit("")).alias("email"),
        F.coalesce(val("account_balance").try_cast("double"), F.lit(0.0)).alias("account_balance"),
        F.coalesce(val("payment_history"), empty).alias("payment_history"),
        F.coalesce(val("risk_factors"), empty).alias("risk_factors"),
        F.coalesce(val("previous_calls").try_cast("int"), F.lit(0)).alias("previous_calls"),
        F.coalesce(val("satisfaction_score").try_cast("double"), F.lit(0.0)).alias("satisfaction_score"),
    )


def call_history(calls: DataFrame) -> DataFrame:
    """SRC-6 / TOP-3: all calls of every customer, newest first, as rows
    (customer_id, call_rank, history_count, 5-field record).  Long form: a
    customer's history is never gathered into one list or one task."""
    c = calls.select(F.col("record_no").alias("customer_id"), "contact_id", "start_ts", "agent",
                     "total_conversation_duration", "customer_sentiment_score", "unpaid_flag")
    ranked = rank_within(c, ["customer_id"], [F.col("start_ts").desc(), F.col("contact_id").desc()],
                         out="call_rank", total="history_count")
    return ranked.select("customer_id", "call_rank", "history_count",
                         F.col("start_ts").alias("timestamp"), F.col("agent").alias("agent_id"),
                         F.col("total_conversation_duration").alias("call_duration"),
                         F.col("customer_sentiment_score").alias("sentiment_score"),
                         F.col("unpaid_flag").alias("payment_outcome"))


_EVENT_TYPES = {"START": "AGENT_CONNECTED", "END": "DISCONNECTED"}


def contact_events_json(snapshots: DataFrame) -> DataFrame:
    """Contact events in their wire form (``{"detail": {...}}`` JSON), one per
    snapshot event: START -> AGENT_CONNECTED, END -> DISCONNECTED, others
    CONNECTED_TO_SYSTEM."""
    et = F.when(F.col("kind") == "START", F.lit(_EVENT_TYPES["START"])) \
        .when(F.col("kind") == "END", F.lit(_EVENT_TYPES["END"])).otherwise(F.lit("CONNECTED_TO_SYSTEM"))
    detail = F.struct(
        F.col("call_id").cast("string").alias("contactId"), et.alias("eventType"),
        F.col("agent_id").alias("agentId"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTimestamp"),
        F.struct(F.col("call_id").cast("string").alias("customer_id")).alias("attributes"))
    return snapshots.select(F.to_json(F.struct(detail.alias("detail"))).alias("event"))


def contact_triggers(raw: DataFrame, col: str = "event") -> DataFrame:
    """SRC-8 / ST-9: parse, keep AGENT_CONNECTED, project contact, customer,
    agent and start time.  Stateless: the same code runs on a stream."""
    d = F.from_json(F.col(col), S.CONTACT_EVENT_SCHEMA).getField("detail")
    p = raw.select(d.alias("d"))
    return (p.filter(F.col("d.eventType") == S.CONTACT_TRIGGER_EVENT)
            .select(F.col("d.contactId").alias("contact_id"),
                    F.col("d.attributes.customer_id").alias("customer_id"),
                    F.col("d.agentId").alias("agent_id"),
                    F.to_timestamp(F.col("d.eventTimestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
                    .alias("started_at")))


def session_state_at(snapshots: DataFrame, at: str) -> DataFrame:
    """Per call, the session state after all control events up to ``at``:
    ACTIVE when the last START/END is a start (a start replaces an open call,
    an end removes it).  One partial-aggregated ``max_by`` per call."""
    ctl = snapshots.filter(F.col("kind").isin("START", "END") & (F.col("ts") <= F.lit(at).cast("timestamp")))
    last = ctl.groupBy("call_id").agg(
        F.max_by(F.struct("kind", "agent_id", "ts"), F.struct("ts", "event_id")).alias("l"))
    return last.select("call_id",
                       F.when(F.col("l.kind") == "START", "ACTIVE").otherwise("ENDED").alias("status"),
                       F.col("l.agent_id").alias("agent_id"), F.col("l.ts").alias("since"))
