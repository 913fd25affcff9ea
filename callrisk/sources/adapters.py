"""Adapter views: derive the application's record shapes from the driver's tables.

The rules are those of FIXTURES.md §B.  Each adapter is a plain DataFrame
plan, so filters and projections applied by callers reach the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import rank_within
from ..schema import TARGET_PAID, TARGET_UNPAID
from .tables import Tables

# Fixed adapter values (FIXTURES.md §B).
SIDES = (("agent", "O"), ("customer", "F"))          # l_linestatus -> speaker side
TONES = (("negative", "R"), ("neutral", "A"), ("positive", "N"))   # l_returnflag -> tone
CRM_BALANCE_FACTOR = 5.0
CRM_HIGH_BALANCE = 30000.0
CRM_IRREGULAR_PENDING = 4
CRM_WATCH_SEGMENT = "MACHINERY"
CRM_HEAVY_CALLER = 12
DAY_MICROS = 86_400_000_000
LIVE_START_MICROS = 41_400_000_000
LIVE_SPEED_UP = 5_000
CONTACT_PARTS = 4               # conversations that follow each other in one contact
AGENT_POOL = 12                 # live calls are assigned to agent-<user_id % 12>


def calls_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Call records (one per order).  Lines are aggregated per order first
    (partial aggregation before the shuffle), then joined to orders on the same
    key, so the join reuses the aggregate's hash partitioning."""
    li = lineitem.select("l_orderkey", "l_quantity", "l_tax", "l_discount",
                         "l_returnflag", "l_linestatus", "l_shipdate")
    aggs = []
    for side, status in SIDES:
        on_side = F.col("l_linestatus") == status
        aggs.append((F.avg(F.when(on_side, F.col("l_discount"))) * 100.0)
                    .alias(f"{side}_loudness_mean"))
        for tone, flag in TONES:
            aggs.append(F.count_if(on_side & (F.col("l_returnflag") == flag))
                        .alias(f"{side}_{tone}_sentence"))
        aggs.append(F.count_if(on_side).alias(f"{side}_total_sentence"))
        aggs.append(F.sum(F.when(on_side, F.col("l_quantity"))).alias(f"{side}_talktime"))
    aggs += [
        F.sum("l_quantity").alias("total_talktime"),
        F.round(F.sum(F.col("l_quantity") * (1 + 5 * F.col("l_tax"))), 4)
        .alias("total_conversation_duration"),
        F.min("l_shipdate").alias("contract_date"),
    ]
    per_order = li.groupBy("l_orderkey").agg(*aggs)

    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    j = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
    cols = [
        F.col("o_custkey").alias("record_no"),
        F.when(F.col("o_orderstatus") == "P", F.lit(TARGET_UNPAID))
        .otherwise(F.lit(TARGET_PAID)).alias("unpaid_flag"),
        F.col("contract_date").cast("timestamp").alias("contract_date"),
        F.col("o_orderdate").cast("timestamp").alias("start_ts"),
        F.col("o_orderkey").alias("contact_id"),
        F.col("o_orderpriority").alias("agent"),
    ]
    for side, _ in SIDES:
        cols.append(F.col(f"{side}_loudness_mean"))
        for tone, _ in TONES:
            cols.append(F.col(f"{side}_{tone}_sentence"))
        cols.append(F.try_divide(F.col(f"{side}_positive_sentence") - F.col(f"{side}_negative_sentence"),
                                 F.col(f"{side}_total_sentence")).alias(f"{side}_sentiment_score"))
        cols.append(F.col(f"{side}_talktime"))
        cols.append(F.col(f"{side}_total_sentence"))
    cols += [
        F.col("total_conversation_duration"),
        F.col("total_talktime"),
        F.datediff(F.to_date("contract_date"), F.to_date("o_orderdate")).alias("days_call_to_contract"),
        F.when(F.col("total_talktime").isNull(), F.lit("n/a"))
        .otherwise(F.col("total_talktime").cast("bigint").cast("string")).alias("total_talktime_text"),
    ]
    return j.select(*cols)


def payment_history_from_orders(orders: DataFrame) -> DataFrame:
    """Payment statuses of every customer, oldest first, as rows (customer_id, seq,
    status): the whole history, never gathered into one list or one task."""
    o = orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return rank_within(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "seq").select(
        F.col("o_custkey").alias("customer_id"), "seq", F.col("o_orderstatus").alias("status"))


def crm_from_customers(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """CRM customer records.  Counts are exact aggregates; the payment statuses
    themselves stay in long form (``payment_history_from_orders``)."""
    o = orders.select("o_custkey", "o_orderstatus")
    counts = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if(F.col("o_orderstatus") == "P").alias("n_pending"))
    c = customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    j = c.join(counts, c.c_custkey == counts.o_custkey, "left").drop("o_custkey")
    balance = F.col("c_acctbal") * CRM_BALANCE_FACTOR
    n_orders = F.coalesce(F.col("n_orders"), F.lit(0))
    factors = F.filter(F.array(
        F.when(balance > CRM_HIGH_BALANCE, F.lit("high_balance")),
        F.when(F.coalesce(F.col("n_pending"), F.lit(0)) >= CRM_IRREGULAR_PENDING, F.lit("irregular_payments")),
        F.when(balance < 0, F.lit("negative_balance")),
        F.when(F.col("c_mktsegment") == CRM_WATCH_SEGMENT, F.lit("watch_segment")),
        F.when(n_orders >= CRM_HEAVY_CALLER, F.lit("heavy_caller")),
    ), lambda x: x.isNotNull())
    return j.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        balance.alias("account_balance"),
        n_orders.alias("payment_count"),
        factors.alias("risk_factors"),
        n_orders.alias("previous_calls"),
        (F.lit(3.0) + (F.col("c_custkey") % 20).cast("double") / 10.0).alias("satisfaction_score"),
        F.col("c_mktsegment").alias("segment"),
    )


def live_time(ts) -> F.Column:
    """A day's events drawn together to a few seconds from 11:30 on, so that bursts, several scores in one
    period and sessions of a few seconds occur as in live calls."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    of_day = F.pmod(micros, F.lit(DAY_MICROS))
    return F.timestamp_micros(micros - of_day + LIVE_START_MICROS + F.floor(of_day / LIVE_SPEED_UP).cast("long"))


def snapshots_from_events(events: DataFrame) -> DataFrame:
    """Live call snapshots: one row per event of a call (call_id = user_id)."""
    et = F.col("event_type")
    return events.select(
        F.col("event_id"),
        F.col("user_id").alias("call_id"),
        live_time("ts").alias("ts"),
        F.when(et == "signup", "START").when(et == "error", "END").otherwise("SEGMENT").alias("kind"),
        F.when(et == "purchase", "CUSTOMER").when(et.isin("click", "view"), "AGENT")
        .cast("string").alias("speaker"),
        F.concat(F.lit("agent-"), (F.col("user_id") % AGENT_POOL).cast("string")).alias("agent_id"),
        F.lit(None).cast("double").alias("agent_sentiment"),
        (F.least(F.col("value"), F.lit(100.0)) / 50.0 - 1.0).alias("customer_sentiment"),
        F.lit(None).cast("double").alias("confidence"),
        F.col("props"),
    )


def segments_from_conversations(conversations: DataFrame) -> DataFrame:
    """Transcript segments; system turns are dropped.  A contact is ``CONTACT_PARTS`` conversations one
    after the other."""
    role = F.col("role")
    contact = F.floor(F.col("conv_id") / CONTACT_PARTS).cast("long")
    segment = (F.col("conv_id") % CONTACT_PARTS) * 1000 + F.col("turn")
    n = F.length("text")
    pos = ((n % 101) / 100.0).cast("double")
    neg = (((n * 7) % 101) / 100.0).cast("double")
    return (conversations.filter(role.isin("user", "assistant"))
            .select(
                contact.alias("contact_id"),
                F.timestamp_seconds(F.lit(1704067200) + contact * 36000 + segment * 5)
                .alias("timestamp"),
                F.when(role == "user", "CUSTOMER").otherwise("AGENT").alias("speaker"),
                F.col("text"),
                F.lit(1.0).alias("confidence"),
                F.struct(
                    F.when(pos > neg, "POSITIVE").when(neg > pos, "NEGATIVE").otherwise("NEUTRAL")
                    .alias("sentiment"),
                    pos.alias("positive_score"), neg.alias("negative_score"),
                    F.greatest(F.lit(0.0), 1.0 - pos - neg).alias("neutral_score"),
                ).alias("sentiment"),
                segment.alias("segment_id"),
            ))


def profile_from_orders(orders: DataFrame) -> DataFrame:
    """Financial-profile records (one per order)."""
    k = F.col("o_orderkey")
    return orders.select(
        F.col("o_custkey").alias("record_no"),
        k.alias("contact_id"),
        F.col("o_orderdate").cast("timestamp").alias("start_ts"),
        F.col("o_orderpriority").alias("agent"),
        F.when(k % 37 == 0, F.lit(None).cast("double"))
        .otherwise((1000 + k % 9000).cast("double")).alias("annual_income"),
        (18 + k % 90).cast("double").alias("age"),
        F.col("o_totalprice").alias("loan_amount"),
        (100 + k % 700).cast("double").alias("monthly_income"),
        (300 + k % 650).cast("double").alias("credit_score"),
        (F.col("o_orderstatus") == "P").cast("int").alias("unpaid_flag"),
    )


# Convenience constructors over a data directory ------------------------------------------

def calls(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return calls_from_orders(t.orders, t.lineitem)


def crm(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return crm_from_customers(t.customer, t.orders)


def payment_history(spark, sf_dir):
    return payment_history_from_orders(Tables(spark, sf_dir).orders)


def snapshots(spark, sf_dir):
    return snapshots_from_events(Tables(spark, sf_dir).events)


def segments(spark, sf_dir):
    return segments_from_conversations(Tables(spark, sf_dir).conversations)


def profile(spark, sf_dir):
    return profile_from_orders(Tables(spark, sf_dir).orders)
