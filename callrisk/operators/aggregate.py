"""Per-customer aggregation and summary aggregates (AGG-1..10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .clean import numeric_columns


def sums_by_name(cols) -> dict:
    """Name rule: a lower-cased name containing 'sentence' or 'count' is summed,
    everything else averaged (so ratios named *sentence* are summed too)."""
    return {c: ("sum" if any(m in c.lower() for m in S.SUM_NAME_MARKERS) else "mean") for c in cols}


def customer_rollup(df: DataFrame, key: str = S.ID_COL, target: str = S.TARGET_COL,
                    rule: dict | None = None) -> DataFrame:
    """AGG-2: one row per customer, one shuffle.

    Sum/mean by the name rule (all-null sums give 0), the modal target (smallest
    value on ties; the target is a two-valued label, so the mode buffer stays
    tiny), and the number of calls.  Null customer keys are dropped first.
    Partial aggregation runs before the shuffle, so a customer holding a third
    of all calls costs one row per map task in the exchange.
    """
    cols = numeric_columns(df, (key, target))
    how = sums_by_name(cols)
    how.update(rule or {})
    aggs = []
    for c in cols:
        if how[c] == "sum":
            aggs.append(F.coalesce(F.sum(c), F.lit(0).cast(df.schema[c].dataType)).alias(c))
        else:
            aggs.append(F.avg(c).alias(c))
    aggs.append(F.mode(target, True).alias(target))
    aggs.append(F.count(F.lit(1)).alias("call_count"))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def customer_means(df: DataFrame, order_by, key: str = S.ID_COL, target: str = S.TARGET_COL) -> DataFrame:
    """AGG-1/AGG-3: mean of every numeric column, first non-null target in
    ``order_by`` order (rows with a null order are skipped for the pick)."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    cols = numeric_columns(df, (key, target, *order_by))
    ordv = F.struct(*[F.col(o) for o in order_by])
    usable = F.col(target).isNotNull()
    for o in order_by:
        usable = usable & F.col(o).isNotNull()
    first_target = F.min_by(F.when(usable, F.col(target)), F.when(usable, ordv))
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(*[F.avg(c).alias(c) for c in cols], first_target.alias(target)))


def value_counts(df: DataFrame, col: str, name: str = "value", categorical: bool = True) -> DataFrame:
    """AGG-4: count and percentage per value (null is its own value).

    For a categorical column (target, band, sentiment label, split side) the
    total comes from a window over the grouped rows, one row per category, so
    the input plan runs once.  For a column with unbounded distinct values
    (``categorical=False``) the total is one scalar aggregate instead, so no
    task ever holds all the values."""
    g = df.groupBy(F.col(col).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    if categorical:
        return g.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))))
    total = df.count()
    return g.withColumn("pct", F.col("n") * 100.0 / F.lit(total))


def score_summary(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """AGG-5: n, mean, population std, min, max."""
    s = F.col(score)
    return df.agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"),
                  F.min(s).alias("min"), F.max(s).alias("max"))


def dashboard_summary(df: DataFrame, score: str = "risk_score", band_col: str = "risk_category",
                      high_label: str = "High Risk") -> DataFrame:
    """AGG-6: mean, high-band percentage, sample std."""
    return df.agg(F.avg(score).alias("mean"),
                  (F.avg(F.when(F.col(band_col) == high_label, 1.0).otherwise(0.0)) * 100).alias("high_pct"),
                  F.stddev_samp(score).alias("std"))


def kpi_overview(df: DataFrame, score: str = "risk_score", band_col: str = "risk_category",
                 high_label: str = "High Risk", label: str | None = None, pred: str | None = None) -> DataFrame:
    """AGG-7: total rows, high-band count, mean score, and accuracy when labels exist."""
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col(band_col) == high_label).alias("high_risk"),
            F.avg(score).alias("mean_score")]
    if label and pred:
        aggs.append(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))
    return df.agg(*aggs)


def distinct_customers(df: DataFrame, key: str = S.ID_COL, approx: bool = False) -> DataFrame:
    """AGG-8: number of distinct customers (exact two-phase distinct, or HLL)."""
    if approx:
        return df.agg(F.approx_count_distinct(key).alias("customers"))
    return df.select(key).filter(F.col(key).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("customers"))


def band_distribution(df: DataFrame, band_col: str = "risk_category") -> DataFrame:
    """AGG-9 distribution part: count and share of each band (the bands are a
    fixed label set, so the total is a window over at most that many rows)."""
    return value_counts(df, band_col, band_col)


def live_gauges(sessions: DataFrame) -> DataFrame:
    """AGG-10: active calls and distinct active agents from the latest session state."""
    active = sessions.filter(F.col("status") == "ACTIVE")
    return active.agg(F.count(F.lit(1)).alias("active_calls"),
                      F.count_distinct("agent_id").alias("active_agents"))
