"""Transcript views (TOP-4..6, SC-14, SC-15, ST-3, ST-4) over segment rows.

The buffer keeps the last ``SEGMENT_BUFFER`` segments of each contact.  ``row_number()
<= n`` gets a partial group limit before the shuffle, so a contact with a very long
transcript sends at most n rows from each task.  The views are per-contact
aggregates over the buffer (at most ten rows per contact).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S


def segment_buffer(segments: DataFrame, n: int = S.SEGMENT_BUFFER) -> DataFrame:
    """TOP-4 / ST-3: last ``n`` segments per contact, ``pos`` 1 = newest."""
    newest = Window.partitionBy("contact_id").orderBy(F.col("segment_id").desc())
    return segments.withColumn("pos", F.row_number().over(newest)).filter(F.col("pos") <= n)


def transcript_view(segments: DataFrame, n: int = S.SEGMENT_BUFFER) -> DataFrame:
    """TOP-5 / ST-4: latest segment, buffered count (at most ``n``) and seconds since the call's first
    segment; one aggregate over all segments."""
    return segments.groupBy("contact_id").agg(
        F.max("segment_id").alias("latest_segment_id"),
        F.max_by("speaker", "segment_id").alias("latest_speaker"),
        F.least(F.count(F.lit(1)), F.lit(n)).alias("segment_count"),
        (F.unix_seconds(F.max("timestamp")) - F.unix_seconds(F.min("timestamp"))).alias("call_duration"))


def overall_sentiment(buf: DataFrame) -> DataFrame:
    """SC-14: improvement = last customer positive - first customer negative;
    > 0.3 POSITIVE, > -0.2 NEUTRAL, else NEGATIVE; trend > 0.2 IMPROVING,
    > -0.2 STABLE, else DECLINING; confidence 0.8, or 0.5 without customer turns."""
    is_c = F.col("speaker") == "CUSTOMER"
    g = buf.groupBy("contact_id").agg(
        F.min_by(F.when(is_c, F.col("sentiment.negative_score")), F.when(is_c, F.col("segment_id")))
        .alias("first_neg"),
        F.max_by(F.when(is_c, F.col("sentiment.positive_score")), F.when(is_c, F.col("segment_id")))
        .alias("last_pos"),
        F.count_if(is_c).alias("n_customer"))
    imp = F.col("last_pos") - F.col("first_neg")
    has = F.col("n_customer") > 0
    return g.select(
        "contact_id",
        F.when(has, imp).alias("improvement_score"),
        F.when(~has, "NEUTRAL").when(imp > 0.3, "POSITIVE").when(imp > -0.2, "NEUTRAL")
        .otherwise("NEGATIVE").alias("overall_sentiment"),
        F.when(~has, F.lit(None).cast("string")).when(imp > 0.2, "IMPROVING").when(imp > -0.2, "STABLE")
        .otherwise("DECLINING").alias("satisfaction_trend"),
        F.when(has, 0.8).otherwise(0.5).alias("confidence"))


def call_summary(buf: DataFrame) -> DataFrame:
    """SC-15: RESOLVED when more than 5 buffered segments, follow-up when more than 8."""
    g = buf.groupBy("contact_id").agg(F.count(F.lit(1)).alias("total_segments"))
    n = F.col("total_segments")
    return g.select(
        "contact_id", "total_segments", F.lit(S.SUMMARY_CALL_TYPE).alias("call_type"),
        F.when(n > S.SUMMARY_RESOLVED_ABOVE, "RESOLVED").otherwise("IN_PROGRESS").alias("resolution_status"),
        (n > S.SUMMARY_FOLLOW_UP_ABOVE).alias("follow_up_required"),
        F.lit(False).alias("escalation_occurred"),
        F.array(*[F.lit(t) for t in S.SUMMARY_TOPICS]).alias("key_topics"))
