"""Display formats of the original application as column
expressions: metric titles, fixed digits, money, percent, counts, JST dates,
deterministic call codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import hash_hex8
from .scalar import col

# Display formats of the original.
YEN = "¥"
TIMES_SUFFIX = "回"
TIMEZONE = "Asia/Tokyo"
DATE_FORMAT = "yyyy年MM月dd日"
TIME_FORMAT = "HH時mm分"
CALL_CODE_PREFIX = "CALL-"
CALL_CODE_TIME = "yyyyMMdd-HHmmss"


def metric_title(name) -> Column:
    """'roc_auc' -> 'Roc Auc' (underscores to spaces, words capitalised)."""
    return F.initcap(F.regexp_replace(col(name), "_", " "))


def fixed(value, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", col(value))


def yen(value) -> Column:
    """Money with thousands separators and no decimals: ¥61,728."""
    return F.concat(F.lit(YEN), F.format_number(col(value), 0))


def percent(ratio, digits: int = 1) -> Column:
    """A ratio as a percentage: 0.123 -> '12.3%'."""
    return F.format_string(f"%.{digits}f%%", col(ratio) * 100.0)


def times(n) -> Column:
    """A count of occurrences: 5 -> '5回'."""
    return F.concat(col(n).cast("string"), F.lit(TIMES_SUFFIX))


def jst_date(ts) -> Column:
    return F.date_format(F.from_utc_timestamp(col(ts), TIMEZONE), DATE_FORMAT)


def jst_time(ts) -> Column:
    return F.date_format(F.from_utc_timestamp(col(ts), TIMEZONE), TIME_FORMAT)


def call_code(ts, key) -> Column:
    """'CALL-<yyyyMMdd-HHmmss>-<4 digits>'; the digits come from a hash of the
    natural key instead of a random draw, so a replayed event gets the same code."""
    digits = F.lit(1000) + F.conv(hash_hex8(key), 16, 10).cast("long") % 9000
    return F.concat(F.lit(CALL_CODE_PREFIX), F.date_format(col(ts), CALL_CODE_TIME), F.lit("-"),
                    digits.cast("string"))
