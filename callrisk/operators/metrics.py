"""Split assignment and classification metrics (ML-1, ML-2, MET-1..5).

Everything is an aggregate over (label, prediction) counts, so the work is a
partial-aggregated scan whatever the table size; AUC and ROC live in
``functions.ranking`` (distributed prefix sums over distinct scores).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import hashing as H
from ..functions.ranking import rank_within


def split_columns(df: DataFrame, key: str, label: str = "label", test_share: float = 0.2) -> DataFrame:
    """ML-1: ``is_test`` (hash below 0x33333333, i.e. 20 %), ``fold`` (five hash
    ranges) and ``is_test_exact``: the first ``round(share * n_class)`` rows of
    each class in hash order, ranked by the range-partitioned rank job (a class
    holding most rows is still split over many tasks)."""
    h = df.withColumn("_h", H.hash_hex8(key))
    ranked = rank_within(h, [label], [F.col("_h"), F.col(key)], out="_r", total="_n")
    return ranked.select(
        key, label, (F.col("_h") < F.lit(S.TEST_FRACTION_HEX)).alias("is_test"),
        H.fold_of(key).alias("fold"),
        (F.col("_r") <= F.round(F.lit(test_share) * F.col("_n"))).alias("is_test_exact"))


def predict_at(df: DataFrame, p: str, threshold: float = 0.5, out: str = "pred") -> DataFrame:
    return df.withColumn(out, (F.col(p) >= F.lit(threshold)).cast("int"))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """MET-3: 2 x 2 counts, zero-filled (one aggregate row, then stacked)."""
    one = df.agg(*[F.count_if((F.col(label) == a) & (F.col(pred) == b)).alias(f"c{a}{b}")
                   for a in (0, 1) for b in (0, 1)])
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"), F.col(f"c{a}{b}").alias("n"))
                      for a in (0, 1) for b in (0, 1)])
    return one.select(F.inline(cells))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """MET-1 / MET-4 / MET-5: per class precision, recall, F1, support; macro and
    weighted averages; accuracy.  Undefined ratios are 0 (as the original's
    report does with its zero-division default)."""
    aggs = []
    for c in (0, 1):
        aggs += [F.count_if((F.col(pred) == c) & (F.col(label) == c)).alias(f"tp{c}"),
                 F.count_if(F.col(pred) == c).alias(f"pr{c}"),
                 F.count_if(F.col(label) == c).alias(f"su{c}")]
    aggs += [F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col(pred)).alias("ok")]
    one = df.agg(*aggs)

    def safe(num, den):
        return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)
    cols = {}
    for c in (0, 1):
        p = safe(F.col(f"tp{c}"), F.col(f"pr{c}"))
        r = safe(F.col(f"tp{c}"), F.col(f"su{c}"))
        cols[f"p{c}"], cols[f"r{c}"] = p, r
    one = one.select("*", *[v.alias(k) for k, v in cols.items()])
    for c in (0, 1):
        p, r = F.col(f"p{c}"), F.col(f"r{c}")
        one = one.withColumn(f"f{c}", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))
    su0, su1 = F.col("su0").cast("double"), F.col("su1").cast("double")
    tot = su0 + su1

    def wavg(m):
        return (F.col(f"{m}0") * su0 + F.col(f"{m}1") * su1) / tot

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        s.cast("long").alias("support"))
    rows = F.array(
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("su0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("su1")),
        row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
            (F.col("f0") + F.col("f1")) / 2, F.col("su0") + F.col("su1")),
        row("weighted avg", wavg("p"), wavg("r"), wavg("f"), F.col("su0") + F.col("su1")),
        row("accuracy", F.lit(None), F.lit(None), F.col("ok") / F.col("n"), F.col("n")),
    )
    return one.select(F.inline(rows))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """MET-1 with the majority-class rate beside it (a model must beat it)."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                  F.greatest(F.avg(F.col(label).cast("double")), 1 - F.avg(F.col(label).cast("double")))
                  .alias("majority_rate"))
