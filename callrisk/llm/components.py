"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    Each round links every node's larger neighbours to its least neighbour, then its smaller ones,
    and writes the edges to the shared folder, until nothing changes.  A hub's neighbours meet in one
    aggregated minimum, never in a list, so the work of a round is proportional to the edges.
    Self-links, repeated edges and nulls add nothing; no edges give no rows.
    """
    links = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where("u is not null and u <> v").distinct())
    links = written(links, "links")
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")) \
            .select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        # every row of ``large`` points down: attach each node's smaller neighbours to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").unionAll(down.select("u", F.col("m").alias("v"))).distinct())
        new = written(small, "links")
        old_sum, new_sum = (x.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast(
            "decimal(38,0)")), F.lit(0)).alias("s")).first() for x in (links, new))
        links = new
        if old_sum == new_sum:
            break
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
