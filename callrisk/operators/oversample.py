"""Minority oversampling (ML-11): synthetic rows between a minority row and one of its nearest neighbours.

The original draws rows and neighbours at random; here every draw comes from a hash of the row's id and the
copy number, so results depend neither on partitions nor on retries, and every minority row gets the same
number of copies (one more for the first ones in hash order) until both classes are equal.  Only the rows
given are used: pass training rows, so that nothing leaks into a test split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import hashing as H
from ..functions.ranking import rank_within
from ..session import growing, passing, stored
from .neighbours import knn_join

NEIGHBOURS = 5
#: Fixed value: with fewer minority rows the original does not oversample.
LEAST_ROWS = 10


def _draw(salt: str, seed: int) -> F.Column:
    return F.conv(H.hash_hex8(F.concat_ws("|", F.col("base").cast("string"), F.col("copy").cast("string")), seed, salt),
                  16, 10).cast("long")


def minority(df: DataFrame, label: str) -> tuple[object, int, int]:
    """(label value of the smaller class, its rows, rows missing to parity); ties: nothing is missing."""
    sizes = sorted((r["n"], r["y"]) for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("y"))
                   .agg(F.count(F.lit(1)).alias("n")).collect())   # one row per class
    if len(sizes) != 2:
        return None, 0, 0
    return sizes[0][1], sizes[0][0], sizes[1][0] - sizes[0][0]


def synthetic_rows(df: DataFrame, features: list[str], id_col: str, label: str = "label", k: int = NEIGHBOURS,
                   seed: int = S.SPLIT_SEED) -> DataFrame:
    """(base, copy, neighbour, gap, features..., label): as many rows as the smaller class lacks.

    The value of a feature is x + gap * (y - x) with x of the base row, y of its neighbour and gap in [0, 1).
    Rows with a null id or a null or non-finite feature are left out; no rows come out where a class has fewer
    than ``LEAST_ROWS`` rows or both are equal.
    """
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), label) \
        .where(F.col("id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    value, n, need = minority(rows, label)
    if n < LEAST_ROWS or not need:
        return df.sparkSession.createDataFrame([], T.StructType(
            [T.StructField("base", kind), T.StructField("copy", T.LongType()), T.StructField("neighbour", kind),
             T.StructField("gap", T.DoubleType()), *[T.StructField(c, T.DoubleType()) for c in features],
             T.StructField(label, df.schema[label].dataType)]))
    small = stored(rows.where(F.col(label) == F.lit(value)).select("id", "x"), "minority")
    with passing(df.sparkSession):
        links = stored(knn_join(small.select("id", *[F.col("x")[i].alias(c) for i, c in enumerate(features)]), features, k, "id")
                       .select(F.col("id").alias("base"), "rank", "neighbour"), "minority-links", keep=True)
    ranked = rank_within(small.select("id").withColumn("_h", H.hash_hex8("id", seed)), [], ["_h", "id"], out="place")
    copies = F.lit(need // n) + F.when(F.col("place") <= need % n, 1).otherwise(0)
    drawn = ranked.select(F.col("id").alias("base"), copies.alias("copies")).where("copies > 0") \
        .select("base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("copy"))
    drawn = drawn.withColumn("rank", (_draw("neighbour", seed) % min(k, n - 1) + 1).cast("int")) \
        .withColumn("gap", _draw("gap", seed).cast("double") / 4294967296.0)
    paired = (growing(drawn, n).join(links, ["base", "rank"])
              .join(growing(small.select(F.col("id").alias("base"), "x"), n), "base")
              .join(growing(small.select(F.col("id").alias("neighbour"), F.col("x").alias("y")), n), "neighbour"))
    x, y = F.col("x"), F.col("y")
    return paired.select("base", "copy", "neighbour", "gap",
                         *[(x[i] + F.col("gap") * (y[i] - x[i])).alias(c) for i, c in enumerate(features)],
                         F.lit(value).cast(df.schema[label].dataType).alias(label))


def oversampled(df: DataFrame, features: list[str], id_col: str, label: str = "label", k: int = NEIGHBOURS,
                seed: int = S.SPLIT_SEED) -> DataFrame:
    """(features..., label): the rows of ``df`` and the synthetic ones, both classes of equal size."""
    made = synthetic_rows(df, features, id_col, label, k, seed).select(*features, label)
    return df.select(*[F.col(c).cast("double").alias(c) for c in features], label).unionByName(made)
