"""Centroid clustering of integer vectors with a vantage-point tree over the centroids.

Every round builds a vantage-point tree over the current centroids (at most ``k`` rows) and broadcasts it.
Each vector searches it best first: of its open nodes it takes the one of least possible distance, measures
the exact integer distance to the node's centroids, and opens the children that the triangle inequality
cannot exclude.  The pruning radius is inclusive: a node whose bound equals the best distance is still
opened, so that ties go to the smaller centroid number.  A batch of vectors searches side by side in numpy.
The tasks send one row of sums per cluster; new centroids are exact floors of sum / count.

Vectors are floor(scale * x) of every component, as exact integers: 64-bit where squared distances are sure
to fit, Python integers beyond, where no node is pruned.

Defined results: rows whose vector is null, has another number of components, or holds a null or non-finite
component are left out; repeated rows are clustered each; a null id hashes as the empty text; equal start
hashes are ordered by vector; fewer kept vectors than ``k`` give as many centroids; a distance or inertia
beyond 2^63 - 1 is given as that number (assignments stay exact); extra columns are left out; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tasks import written

#: Centroids of a leaf of the tree.
LEAF = 4
#: Components below this size have squared distances below 2^63 (64 components).
SAFE = 1 << 27
LONG = (1 << 63) - 1
#: Bits of a sum that one column carries.
LIMB = 60


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64 where all are below SAFE, else Python integers."""
    scaled = np.floor(x * scale)
    if not x.size or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    exact = [int(v) * scale if abs(v) > 2 ** 60 else int(s) for v, s in zip(x.ravel().tolist(), scaled.ravel().tolist())]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


def is_small(x: np.ndarray) -> bool:
    return x.dtype != object


def narrowed(rows: list[list[int]]) -> np.ndarray:
    """Python integers as int64 if all are below SAFE, else as objects."""
    small = all(-SAFE < v < SAFE for r in rows for v in r)
    out = np.empty((len(rows), len(rows[0]) if rows else 0), np.int64 if small else object)
    for i, r in enumerate(rows):
        out[i] = r
    return out


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to one point."""
    if is_small(x) and is_small(point):
        gap = x - point
        return np.einsum("ij,ij->i", gap, gap)
    gap = x.astype(object) - point.astype(object)
    return (gap * gap).sum(axis=1)


class Tree:
    """Vantage-point tree: inner nodes have a vantage centroid, two children and the least and greatest
    distance of each child's centroids to the vantage point; leaves hold up to LEAF centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.members: list[list[int]] = []
        self.children: list[list[tuple[int, float, float]]] = []
        if len(centroids):
            self._build(list(range(len(centroids))))

    def _build(self, numbers: list[int]) -> int:
        node = len(self.members)
        self.members.append(numbers)
        self.children.append([])
        if len(numbers) <= LEAF:
            return node
        gaps = squared(self.centroids[numbers], self.centroids[numbers[0]])
        vantage = numbers[int(np.argmax(gaps))]  # an outer point splits better than a central one
        rest = [c for c in numbers if c != vantage]
        gaps = squared(self.centroids[rest], self.centroids[vantage])
        order = sorted(range(len(rest)), key=lambda i: (gaps[i], rest[i]))
        self.members[node] = [vantage]
        for part in (order[:len(order) // 2], order[len(order) // 2:]):
            low, high = (self.root(gaps[part[i]]) for i in (0, -1))
            self.children[node].append((self._build(sorted(rest[i] for i in part)), low, high))
        return node

    @staticmethod
    def root(square) -> float:
        return float(square) ** 0.5 if square < 1 << 63 else float("inf")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and exact squared distance of the nearest centroid of each row; ties: the smaller number."""
        n, prune = len(x), is_small(x) and is_small(self.centroids)
        best = np.full(n, LONG, np.int64) if prune else np.array([None] * n, object)
        number = np.full(n, len(self.centroids), np.int64)
        radius = np.full(n, np.inf)
        bound = np.full((n, len(self.members)), np.inf)
        bound[:, 0] = 0.0
        rows = np.arange(n)
        while len(rows):
            node = np.argmin(bound[rows], axis=1)
            least = bound[rows, node]
            # inclusive: a node at exactly the best distance may hold a smaller number
            open_ = (least < np.inf) & (least <= radius[rows])
            rows, node, least = rows[open_], node[open_], least[open_]
            bound[rows, node] = np.inf
            for k in np.unique(node).tolist():
                mine = rows[node == k]
                part = x[mine]
                for c in self.members[k]:
                    gap = squared(part, self.centroids[c])
                    if prune:
                        closer = (gap < best[mine]) | ((gap == best[mine]) & (c < number[mine]))
                    else:
                        closer = np.array([b is None or g < b or (g == b and c < m)
                                           for g, b, m in zip(gap, best[mine], number[mine])], bool)
                    at = mine[closer]
                    best[at], number[at] = gap[closer], c
                if prune:
                    size = np.sqrt(best[mine].astype(np.float64))
                    radius[mine] = size * (1 + 1e-12) + 1e-9
                if not self.children[k]:
                    continue
                far = np.sqrt(gap.astype(np.float64)) if prune else None
                for child, low, high in self.children[k]:
                    if prune:  # less a margin for the rounding of the roots
                        lower = np.maximum(low - far, far - high) - 1e-12 * (far + high) - 1e-9
                        bound[mine, child] = np.maximum(np.maximum(lower, least[node == k]), 0.0)
                    else:
                        bound[mine, child] = 0.0
        return number, best


def limbs(value: int) -> list[int]:
    """Signed base 2^LIMB digits, least first; only the last may be negative."""
    out = []
    while not -(1 << 62) <= value < 1 << 62:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def vectors(batch: pa.RecordBatch, scale: int, dims: int) -> np.ndarray:
    """The vectors of a batch (column 1: lists of ``dims`` components) as integers."""
    flat = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return integers(flat.reshape(-1, dims), scale)


def assigned(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest``, with rows of small components kept on the 64-bit path."""
    if is_small(x) or not is_small(tree.centroids):
        return tree.nearest(x)
    small = np.array([all(-SAFE < v < SAFE for v in r) for r in x.tolist()], bool)
    number, best = np.zeros(len(x), np.int64), np.array([None] * len(x), object)
    for part, rows in ((small, x[small].astype(np.int64)), (~small, x[~small])):
        if part.any():
            number[part], best[part] = tree.nearest(rows)
    return number, best


def cluster_sums(rows: DataFrame, tree, scale: int, dims: int) -> DataFrame:
    """(cluster, limb, n, s0, s1, ...): per task and cluster the number and the sums of its vectors."""
    names = [f"s{j}" for j in range(dims)]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("limb", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in ("n", *names)]])

    def run(batches):
        k = len(tree.value.centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        large = np.zeros((k, dims), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch, scale, dims)
            number, _ = assigned(tree.value, x)
            count += np.bincount(number, minlength=k)
            if is_small(x):
                np.add.at(total, number, x)
            else:
                for c in np.unique(number).tolist():
                    large[c] += x[number == c].sum(axis=0)
        out = {c: [] for c in ("cluster", "limb", "n", *names)}
        for c in np.flatnonzero(count).tolist():
            digits = [limbs(int(a) + int(b)) for a, b in zip(total[c], large[c])]
            for level in range(max(map(len, digits))):
                out["cluster"].append(c)
                out["limb"].append(level)
                out["n"].append(int(count[c]) if not level else 0)
                for name, d in zip(names, digits):
                    out[name].append(d[level] if level < len(d) else 0)
        if out["n"]:
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("cluster", pa.int32()), ("limb", pa.int32()), *[(c, pa.int64()) for c in ("n", *names)]]))

    return rows.mapInArrow(run, schema)


def moved(centroids: list[list[int]], sums: list) -> list[list[int]]:
    """Componentwise floor(sum / count) of every cluster that has vectors; the others stay."""
    count, total = {}, {}
    for r in sums:
        c = r["cluster"]
        count[c] = count.get(c, 0) + int(r["n"])
        old = total.setdefault(c, [0] * len(centroids[c]))
        total[c] = [v + (int(r[f"s{j}"]) << LIMB * r["limb"]) for j, v in enumerate(old)]
    return [[v // count[c] for v in total[c]] if c in count else old for c, old in enumerate(centroids)]


def start_rows(rows: DataFrame, k: int, prefix: str) -> list[list[float]]:
    """The ``k`` vectors of least sha256 of prefix + id, in that order.

    Only rows below a hash bound that leaves about four times as many are sorted, so the tasks together
    send a bounded number of rows; should too few be left, all are sorted.
    """
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    n = rows.count()
    if n > 8 * k:
        few = hashed.where(F.col("h") < f"{int(2 ** 64 * (4 * k / n)):016x}")
        if few.count() >= k:
            hashed = few
    return [list(r["vector"]) for r in hashed.orderBy("h", "vector").limit(k).collect()]


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, prefix: str = "2:", scale: int = 256, dims: int = 64,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster int, distance long, cluster_inertia, inertia long, centroid array<string>: the final
    centroid's components in decimal) for every kept vector of ``df``."""
    spark = df.sparkSession
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")) \
        .where((F.size("vector") == dims) & ~bad)
    rows = written(rows, "vectors")
    start = np.array(start_rows(rows, k, prefix), np.float64).reshape(-1, dims)
    centroids = [[int(v) for v in r] for r in integers(start, scale).tolist()]
    for _ in range(rounds if centroids else 0):
        tree = spark.sparkContext.broadcast(Tree(narrowed(centroids)))
        sums = cluster_sums(rows, tree, scale, dims).groupBy("cluster", "limb").agg(
            F.sum("n").alias("n"), *[F.sum(F.col(f"s{j}").cast("decimal(38,0)")).alias(f"s{j}") for j in range(dims)])
        centroids = moved(centroids, sums.collect())  # at most k rows and limb
        tree.unpersist()
    tree = spark.sparkContext.broadcast(Tree(narrowed(centroids)))
    kind = rows.schema["id"].dataType

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                number, best = assigned(tree.value, vectors(batch, scale, dims))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(number.astype(np.int32)),
                     pa.array([min(int(b), LONG) for b in best.tolist()], pa.int64())], names=["id", "cluster", "distance"])

    found = written(rows.mapInArrow(run, T.StructType([
        T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])),
        "clusters")
    tree.unpersist()
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    sizes = {r["cluster"]: int(r["own"]) for r in per.collect()}  # at most k rows
    shape = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()),
                          T.StructField("inertia", T.LongType()), T.StructField("centroid", T.ArrayType(T.StringType()))])
    table = [(c, min(s, LONG), min(sum(sizes.values()), LONG), [str(v) for v in centroids[c]])
             for c, s in sorted(sizes.items())]
    return found.join(F.broadcast(spark.createDataFrame(table, shape)), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")

