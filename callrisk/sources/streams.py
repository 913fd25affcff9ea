"""Stream sources (SRC-7, SRC-8): live events and transcript segments.

Offline (tests, replays) the stream is a file source over a folder that
producers append to; in production the same schema is read from a message
bus topic (``fmt="kafka"``; needs the Kafka connector on the classpath) whose
JSON payload is parsed with ``from_json``.  Either way the result is a
streaming DataFrame with the declared schema, so every downstream operator is
the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def read_stream(spark: SparkSession, schema: T.StructType, path: str | None = None, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """A streaming DataFrame of ``schema`` from files (``parquet`` / ``json``) or
    from a topic (``kafka``: options such as ``kafka.bootstrap.servers`` and
    ``subscribe`` are passed through; the message value is JSON)."""
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.options(**options).load(path)


def segment_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """SRC-7: transcript segments (contact, time, speaker, text, confidence,
    sentiment struct, segment id)."""
    return read_stream(spark, S.SEGMENT_SCHEMA, path, fmt, **options)


def contact_event_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """SRC-8: contact events as JSON text lines (column ``event``), ready for
    ``events.contact_triggers``."""
    return spark.readStream.options(**options).text(path).withColumnRenamed("value", "event")
