"""Shared helpers of the registered queries: output rounding and the fixed
reference time that stands in for "now" (results must not depend on the clock)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REF_TIME = "2024-01-15 12:00:00"   # "now" of the live-path twins (UTC)
NUDGE = 1e-12   # relative push off exact .5 boundaries, same on both engines


def round6(c) -> F.Column:
    """Round to 6 digits after a 1e-12 relative nudge, so a value that sits on a
    half-way point rounds the same in Spark (exact decimal) and DuckDB (scaled)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * (1.0 + NUDGE), 6)


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 digits (oracle hygiene)."""
    return df.select(*[round6(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])
