"""Projection, filtering, coercion and imputation operators (PRJ, FLT, IMP)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.ranking import exact_medians, exact_modes
from ..functions.scalar import to_number
from ..session import cut_lineage


# -- plan-time schema helpers (PRJ-2, PRJ-3, PRJ-9, PRF-3) --------------------------------

def numeric_columns(df: DataFrame, exclude=(S.ID_COL, S.TARGET_COL)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=(S.ID_COL, S.TARGET_COL)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def is_call_centre(df: DataFrame) -> bool:
    return any(c in df.columns for c in S.CALL_INDICATORS)


def first_column_containing(df: DataFrame, needle: str) -> str | None:
    return next((c for c in df.columns if needle in c), None)


# -- projections (PRJ-1, PRJ-4, PRJ-5, PRJ-7, PRJ-8) --------------------------------------

def drop_configured(df: DataFrame, cols=S.DROP_COLUMNS) -> DataFrame:
    """Drop the configured columns that exist (missing ones are ignored)."""
    return df.drop(*[c for c in cols if c in df.columns])


def parse_dates(df: DataFrame, cols=S.DATE_COLUMNS) -> DataFrame:
    """Parse date columns; unparseable values become null per row."""
    out = df
    for c in cols:
        if c in df.columns and not isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)):
            out = out.withColumn(c, F.coalesce(F.try_to_timestamp(F.col(c).cast("string")),
                                               F.col(c).cast("string").try_cast("timestamp")))
        elif c in df.columns and isinstance(df.schema[c].dataType, T.TimestampNTZType):
            out = out.withColumn(c, F.col(c).cast("timestamp"))
    return out


def coerce_numeric(df: DataFrame, cols=None, keep=(S.ID_COL, S.TARGET_COL)) -> DataFrame:
    """Every feature column to double; text that is not a number becomes null."""
    cols = [c for c in (cols or df.columns) if c not in keep]
    return df.select(*[to_number(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def encode_label_a(df: DataFrame, target: str = S.TARGET_COL, out: str = "label") -> DataFrame:
    """未払 -> 1, 支払済 -> 0, anything else -> 0; numeric targets pass through."""
    if isinstance(df.schema[target].dataType, T.StringType):
        expr = F.when(F.col(target) == S.TARGET_UNPAID, 1).otherwise(0)
    else:
        expr = F.coalesce(F.col(target).cast("int"), F.lit(0))
    return df.withColumn(out, expr.cast("int"))


def encode_label_b(df: DataFrame, target: str = S.TARGET_COL, out: str = "label") -> DataFrame:
    """1 iff the value equals 未払, else 0 (also for numeric and null values)."""
    return df.withColumn(out, F.coalesce((F.col(target).cast("string") == S.TARGET_UNPAID).cast("int"),
                                         F.lit(0)))


# -- filters (FLT-1..5) -------------------------------------------------------------------

def filter_category(df: DataFrame, col: str, value) -> DataFrame:
    """Equality filter; ``None`` / "all" means no predicate."""
    if value is None or (isinstance(value, str) and value.lower() in ("all", "すべて")):
        return df
    return df.filter(F.col(col) == F.lit(value))


def filter_range(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """Inclusive range; an open end is no bound (equal to the min/max default)."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(col) >= F.lit(lo))
    if hi is not None:
        cond = cond & (F.col(col) <= F.lit(hi))
    return df.filter(cond)


def split_valid(df: DataFrame, required=("call_id", "customer_id", "agent_id")) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): rows lacking any required field go to quarantine with a reason."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""),
                                        F.lit(c)) for c in required]), lambda x: x.isNotNull())
    tagged = df.withColumn("_missing", missing)
    valid = tagged.filter(F.size("_missing") == 0).drop("_missing")
    quarantine = tagged.filter(F.size("_missing") > 0).withColumn(
        "reason", F.concat(F.lit("missing: "), F.array_join("_missing", ","))).drop("_missing")
    return valid, quarantine


def split_null_keys(df: DataFrame, key: str = S.ID_COL) -> tuple[DataFrame, DataFrame]:
    """T9: rows without a customer key are never imputed or grouped; they are
    split off to a quarantine with a reason (the rollup drops them, T8)."""
    ok = F.col(key).isNotNull()
    return df.filter(ok), df.filter(~ok).withColumn("reason", F.lit(f"missing: {key}"))


# -- imputation (IMP-1..4) ----------------------------------------------------------------

def _null_counts(df: DataFrame, cols: list[str]) -> dict:
    if not cols:
        return {}
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return row.asDict()


def median_fill(df: DataFrame, cols=None, exclude=(S.ID_COL, S.TARGET_COL), materialize: bool = False,
                approx_accuracy: int | None = None) -> DataFrame:
    """Fill nulls of numeric columns with the exact global median.

    Key and target are never imputed.  Integral columns that hold nulls become
    double (as an integer column with missing values is float in pandas).  One
    pass counts nulls; the exact medians come from aggregate passes over all columns
    side by side (``functions.selection``) and enter the plan as one value per column,
    so later projections and filters still reach the scans.  ``materialize`` first
    writes the input to the shared checkpoint folder, for inputs that are dear to
    compute several times.
    ``approx_accuracy`` switches to ``percentile_approx`` (one pass, a bounded
    sketch per task, rank error about n / accuracy) as an explicit opt-in.
    """
    cols = list(cols) if cols is not None else numeric_columns(df, exclude)
    if materialize and cols:
        df = cut_lineage(df)
    nulls = _null_counts(df, cols)
    todo = [c for c in cols if nulls.get(c, 0) > 0]
    if not todo:
        return df
    if approx_accuracy:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, approx_accuracy).alias(c)
                       for c in todo]).first()
        med = row.asDict()
    else:
        med = exact_medians(df, todo)
    out = []
    for c in df.columns:
        if c in todo:
            out.append(F.coalesce(F.col(c).cast("double"), F.lit(med.get(c)).cast("double")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def mode_fill(df: DataFrame, cols=None, exclude=(S.ID_COL, S.TARGET_COL), default: str = "Unknown") -> DataFrame:
    """Fill nulls of string columns with the most frequent value (smallest on
    ties); ``Unknown`` when a column is entirely null."""
    cols = list(cols) if cols is not None else string_columns(df, exclude)
    nulls = _null_counts(df, cols)
    todo = [c for c in cols if nulls.get(c, 0) > 0]
    if not todo:
        return df
    modes = {r["column"]: r["mode"] for r in exact_modes(df, todo).collect()}   # one row per column
    return df.fillna({c: (modes.get(c) if modes.get(c) is not None else default) for c in todo})


def mean_fill(df: DataFrame, cols=None, exclude=(S.ID_COL, S.TARGET_COL), materialize: bool = False) -> DataFrame:
    """Fill nulls with the column mean (one aggregate pass); all-null columns stay
    null.  The means enter the plan as one value per column."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude)
    if not cols:
        return df
    if materialize:
        df = cut_lineage(df)
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c]).cast("double")).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def zero_fill(df: DataFrame, cols=None, exclude=(S.ID_COL, S.TARGET_COL)) -> DataFrame:
    """Any remaining null in a numeric column becomes 0."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude)
    return df.select(*[F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def clean_call_records(df: DataFrame) -> DataFrame:
    """Call path cleaning: drop configured columns, parse dates, median/mode fill."""
    return (df.transform(drop_configured).transform(parse_dates)
            .transform(median_fill).transform(mode_fill))
