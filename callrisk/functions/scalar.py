"""Guarded arithmetic and small scalar helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c, replacement: float) -> Column:
    """Replace an exact zero by ``replacement`` (pandas ``replace(0, k)``)."""
    c = col(c)
    return F.when(c == 0, F.lit(replacement)).otherwise(c)


def ratio(num, den) -> Column:
    """Division that yields null instead of raising on a zero divisor (ANSI)."""
    return F.try_divide(col(num), col(den))


def clamp(c, lo: float, hi: float) -> Column:
    c = col(c)
    # greatest/least skip nulls; a null input stays null
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def elapsed_seconds(end, start) -> Column:
    """Total elapsed seconds (never wraps at 24 h)."""
    return (F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))) / 1e6


def to_number(c) -> Column:
    """Coerce any value to double; bad text becomes null (``try_cast``)."""
    return col(c).cast("string").try_cast("double")
