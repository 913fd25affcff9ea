"""Profiling operators (PRF-1..7): null profile, describe, duplicates,
histograms, box statistics, correlations.  All are aggregates; exact
quantiles of columns come from ``functions.selection``, those per group from
the distributed rank job of ``functions.ranking``."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import exact_quantiles
from ..functions.selection import quantiles
from ..session import stored
from .clean import numeric_columns

#: Column pairs of one aggregate: a correlation has six buffers.
PAIRS = 15


def null_profile(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """PRF-1: null count per column in one pass, as (column, nulls)."""
    cols = df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = row.unpivot([], cols, "column", "nulls")
    return long.filter(F.col("nulls") > 0) if only_missing else long


def null_mask(df: DataFrame, key: str) -> DataFrame:
    """PRF-1 mask: one row per input row with a 0/1 indicator per column."""
    return df.select(key, *[F.col(c).isNull().cast("int").alias(c) for c in df.columns if c != key])


def dtype_counts(df: DataFrame) -> list[tuple[str, int]]:
    """PRF-3 (plan-time): number of columns per Spark type."""
    out: dict[str, int] = {}
    for _, t in df.dtypes:
        out[t] = out.get(t, 0) + 1
    return sorted(out.items())


def describe(df: DataFrame, cols=None) -> DataFrame:
    """PRF-2: count, mean, sample std, min, quartiles (exact, interpolated), max
    per numeric column, long form; columns without a value are left out."""
    cols = list(cols) if cols is not None else numeric_columns(df, ())
    x = {c: F.col(c).cast("double") for c in cols}
    moments = [agg(x[c]).alias(f"{name}_{i}") for i, c in enumerate(cols)
               for name, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    quarters, row = quantiles(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, moments)
    rows = [(c, quarters[c]["n"], *[row[f"{m}_{i}"] for m in ("mean", "std", "min", "max")],
             *[quarters[c][q] for q in ("q25", "q50", "q75")]) for i, c in enumerate(cols) if c in quarters]
    return df.sparkSession.createDataFrame(rows, "column string, count long, mean double, std double, min double, "
                                                 "max double, q25 double, q50 double, q75 double")   # one row per column


def duplicate_rows(df: DataFrame, cols=None) -> DataFrame:
    """PRF-4: rows beyond the first identical row (one partial-aggregated group-by)."""
    cols = list(cols) if cols is not None else df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
                 F.sum(F.col("_n") - 1).alias("duplicates"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """PRF-5: equal-width bins between min and max; the max falls in the last
    bin; empty bins are present with 0; lo == hi puts everything in bin 1."""
    x = F.col(col).cast("double")
    stats = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()   # one row
    lo, hi = stats["lo"], stats["hi"]
    spark = df.sparkSession
    frame = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return frame.select("bin", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                            F.lit(0).cast("long").alias("n"))
    width = (hi - lo) / bins
    if hi == lo:
        b = F.when(x.isNotNull(), F.lit(1))
    else:
        # bin = floor((x - lo) * n / (hi - lo)) + 1, the maximum folded into bin n
        # (``least`` skips nulls, so a null x must not reach it)
        b = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)) + 1,
                                          F.lit(bins)).cast("int"))
    counts = df.select(b.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    return (frame.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def box_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """PRF-6: quartiles, whiskers at 1.5 IQR (most extreme points inside the
    fences), outlier count, per group."""
    q = exact_quantiles(df, [col], {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=(by,)).drop("column")
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    x = F.col(col).cast("double")
    j = df.select(F.col(by), x.alias("_x")).filter(F.col("_x").isNotNull()) \
        .join(F.broadcast(q), by)   # q: one row per group of a categorical column
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    return j.groupBy(by).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.first("iqr").alias("iqr"),
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_hi"),
        F.count_if((F.col("_x") < lo_f) | (F.col("_x") > hi_f)).alias("outliers"))


def correlation_long(df: DataFrame, cols=None) -> DataFrame:
    """PRF-7: Pearson correlation of every column pair, long form (a, b, corr).
    Nulls are dropped pair by pair, as pandas does.  The columns are written once;
    an aggregate takes ``PAIRS`` pairs, since Spark compiles no aggregate of more than
    ``spark.sql.codegen.maxFields`` buffers, and reads their columns alone.
    For very wide tables (hundreds of columns) ``ml.stat.Correlation`` over an
    assembled vector is the better plan; this form keeps pairwise null handling."""
    cols = list(cols) if cols is not None else numeric_columns(df, ())
    pairs = list(combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    values = stored(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), "correlated")
    numbered = list(enumerate(pairs))
    parts = [numbered[i:i + PAIRS] for i in range(0, len(numbered), PAIRS)]
    stacked = reduce(DataFrame.unionAll, [
        values.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in part]).unpivot([], [f"{i}" for i, _ in part], "_i", "corr")
        for part in parts])
    names = df.sparkSession.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(pairs)],
                                            "_i string, a string, b string")
    return stacked.join(F.broadcast(names), "_i").select("a", "b", "corr")   # names: one row per pair
