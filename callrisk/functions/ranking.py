"""Exact order statistics without a single-task group.

A global median, mode, AUC or ROC curve is a "group" holding the whole table;
Spark's exact ``median``/``percentile`` aggregates would merge every distinct
value into one task.  Here the work is spread instead:

Quantiles of whole columns need no order at all (``selection``).  Elsewhere:

1. collapse to a frequency table (partial aggregation before the shuffle);
2. range-partition it on (key, value) and write it with the partition number
   (Parquet in the shared folder), fixing which partition each value lives in;
3. running counts inside each partition (bounded by partition size) plus the
   totals of earlier partitions (one row per partition and key) give every
   value its exact global rank.

The per-key outputs are small aggregates (one row per key), reached through
partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions, stored
from .selection import quantiles


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    if not keys:
        raise ValueError("join keys required")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def running_count(freq: DataFrame, keys: list[str], order, weight,
                  partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Inclusive running sum of ``weight`` in ``order`` within each key.

    ``weight`` is a column name (result ``_cum``, totals ``_total``) or a list
    of names (results ``_cum_<w>``, totals ``_total_<w>``).  Returns (rows with
    running sums, per-key totals).  The partition table (partitions x keys
    rows) is the only thing joined back; it is tiny for global statistics and
    grows with keys otherwise, so the join strategy is left to adaptive
    execution rather than forced to broadcast.
    """
    single = isinstance(weight, str)
    weights = [weight] if single else list(weight)
    cum = (lambda w: "_cum") if single else (lambda w: f"_cum_{w}")
    tot = (lambda w: "_total") if single else (lambda w: f"_total_{w}")
    spark = freq.sparkSession
    p = partitions or shuffle_partitions(spark)
    order = [order] if isinstance(order, str) else list(order)
    parted = freq.repartitionByRange(p, *keys, *order).withColumn("_pid", F.spark_partition_id())
    parted = stored(parted, "ranked")
    w_local = (Window.partitionBy("_pid", *keys).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = parted.select("*", *[F.sum(w).over(w_local).alias(f"_l_{w}") for w in weights])
    ptot = parted.groupBy("_pid", *keys).agg(*[F.sum(w).alias(f"_p_{w}") for w in weights])
    w_off = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = ptot.select("_pid", *keys, *[F.coalesce(F.sum(f"_p_{w}").over(w_off), F.lit(0)).alias(f"_o_{w}")
                                        for w in weights])
    totals = ptot.groupBy(*keys).agg(*[F.sum(f"_p_{w}").alias(tot(w)) for w in weights])
    ranked = _null_safe_join(local, offs, ["_pid", *keys])
    ranked = ranked.select(*[c for c in freq.columns],
                           *[(F.col(f"_l_{w}") + F.col(f"_o_{w}")).alias(cum(w)) for w in weights])
    return ranked, totals


def rank_within(df: DataFrame, keys: list[str], order: list, out: str = "rank",
                total: str | None = None, partitions: int | None = None) -> DataFrame:
    """Row number (1-based) of each row within ``keys`` in ``order`` (which must
    be a total order, e.g. end with a unique id), plus the key's row count
    when ``total`` is given.

    Unlike ``row_number().over(partitionBy(keys))``, a key holding a third of
    all rows is not sorted in one task: the range partitioning splits it into
    many partitions and each partition adds the counts of the earlier ones.
    """
    one = df.withColumn("_one", F.lit(1))
    ranked, totals = running_count(one, keys, order, "_one", partitions)
    ranked = ranked.withColumn(out, F.col("_cum").cast("long")).drop("_one", "_cum")
    if total:
        ranked = _null_safe_join(ranked, totals.withColumnRenamed("_total", total)
                                 .withColumn(total, F.col(total).cast("long")), keys)
    return ranked


def next_in_order(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                  partitions: int | None = None) -> DataFrame:
    """Add ``next_<v>`` for each of ``values``: the value on the following row
    of the same key in ``order`` (columns, ascending; a total order), or null.

    ``lead`` over ``partitionBy(keys)`` would sort a hot key in one task.  Here
    rows are range-partitioned on (keys, order); ``lead`` runs inside each
    partition, and the last row of a key in a partition takes the first row of
    that key in the next partition holding it (a table of one row per
    partition and key).
    """
    p = partitions or shuffle_partitions(df.sparkSession)
    parted = stored(df.repartitionByRange(p, *keys, *order).withColumn("_pid", F.spark_partition_id()), "ranked")
    w = Window.partitionBy("_pid", *keys).orderBy(*order)
    local = parted.select("*", *[F.lead(v).over(w).alias(f"_ln_{v}") for v in values],
                          F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    firsts = parted.groupBy("_pid", *keys).agg(
        F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    w_next = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_pid")
    nxt = firsts.select("_pid", *keys, F.lead("_first").over(w_next).alias("_nf"))
    j = _null_safe_join(local, nxt, ["_pid", *keys])
    out = [F.col(c) for c in df.columns]
    out += [F.when(F.col("_last"), F.col("_nf").getField(v)).otherwise(F.col(f"_ln_{v}")).alias(f"next_{v}")
            for v in values]
    return j.select(*out)


def long_values(df: DataFrame, cols: list[str], by: tuple = (), name: str = "column",
                value: str = "value") -> DataFrame:
    """Stack numeric columns into (by..., column, value) with value as double; nulls dropped."""
    casted = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    return (casted.unpivot(list(by), cols, name, value)
            .filter(F.col(value).isNotNull()))


def exact_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float], by: tuple = (),
                    partitions: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (pandas / ``quantile_cont`` semantics).

    Output: one row per (by..., column) with one column per entry of
    ``probs`` (alias -> probability) plus ``n`` (non-null count).  Quantiles of whole columns come from
    ``selection``, those of groups (of any number) from the rank job.
    """
    by = tuple(by)
    if not by:
        found, _ = quantiles(df, cols, probs)
        return df.sparkSession.createDataFrame(
            [(c, v["n"], *[v[a] for a in probs]) for c, v in found.items()],                 # one row per column
            "column string, n long, " + ", ".join(f"{a} double" for a in probs))
    keys = [*by, "column"]
    long = long_values(df, cols, by)
    freq = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_w"))
    ranked, totals = running_count(freq, keys, "value", "_w", partitions)
    j = _null_safe_join(ranked, totals, keys)
    prev = F.col("_cum") - F.col("_w")
    aggs = [F.first("_total").alias("n")]
    for alias, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        aggs.append(F.max(F.when((prev <= lo) & (lo < F.col("_cum")), F.col("value"))).alias(f"_{alias}_lo"))
        aggs.append(F.max(F.when((prev <= hi) & (hi < F.col("_cum")), F.col("value"))).alias(f"_{alias}_hi"))
        aggs.append(F.first(h - lo).alias(f"_{alias}_frac"))
    g = j.groupBy(*keys).agg(*aggs)
    out = [*keys, "n"]
    for alias in probs:
        lo, hi, fr = F.col(f"_{alias}_lo"), F.col(f"_{alias}_hi"), F.col(f"_{alias}_frac")
        out.append((lo + (hi - lo) * fr).alias(alias))
    return g.select(*out)


def exact_medians(df: DataFrame, cols: list[str]) -> dict:
    """Global exact medians as a small dict (one value per column)."""
    if not cols:
        return {}
    return {c: v["median"] for c, v in quantiles(df, cols, {"median": 0.5})[0].items()}


def exact_modes(df: DataFrame, cols: list[str], by: tuple = ()) -> DataFrame:
    """Most frequent value per column (smallest on ties, nulls ignored).

    Counts are partial-aggregated; the pick is ``min_by`` over (-count, value),
    a bounded buffer per column, so no column's values meet in one task.
    """
    by = tuple(by)
    casted = df.select(*by, *[F.col(c).cast("string").alias(c) for c in cols])
    long = casted.unpivot(list(by), cols, "column", "value").filter(F.col("value").isNotNull())
    freq = long.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("_n"))
    return freq.groupBy(*by, "column").agg(
        F.min_by("value", F.struct((-F.col("_n")).alias("k"), F.col("value").alias("v"))).alias("mode"))


def auc_from_scores(df: DataFrame, label: str, score: str, partitions: int | None = None,
                    by: tuple = ()) -> DataFrame:
    """Exact ROC-AUC with ties counted half: rank-sum over distinct scores.

    One row (one per value of ``by``): ``auc`` (null when one class is absent), ``n_pos``, ``n_neg``.
    """
    by_score = df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) != 1).alias("n_neg"))
    ranked, _ = running_count(by_score, list(by), "s", "n_neg", partitions)
    below = F.col("_cum") - F.col("n_neg")
    agg = ranked.groupBy(*by).agg(
        F.sum(F.col("n_pos") * (below + 0.5 * F.col("n_neg"))).alias("_u"),
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    return agg.select(
        *by, F.try_divide(F.col("_u"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"),
        F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


def roc_points(df: DataFrame, label: str, score: str, partitions: int | None = None) -> DataFrame:
    """(threshold, tpr, fpr) for every distinct score, cumulative from the top."""
    by_score = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) != 1).alias("n_neg"))
    desc = by_score.withColumn("_neg_t", -F.col("threshold"))
    ranked, totals = running_count(desc, [], "_neg_t", ["n_pos", "n_neg"], partitions)
    tot = totals.first()   # one row, from the stored partition table
    tot = {"P": tot["_total_n_pos"], "N": tot["_total_n_neg"]}
    return ranked.select(
        "threshold",
        F.try_divide(F.col("_cum_n_pos").cast("double"), F.lit(tot["P"]).cast("double")).alias("tpr"),
        F.try_divide(F.col("_cum_n_neg").cast("double"), F.lit(tot["N"]).cast("double")).alias("fpr"))
