"""Exact k-nearest-neighbour join by boxes along the principal axes (JN-5).

Rows with equal vectors are one point with its k + 1 least ids.  A bounded sample lays out the principal axes
and splits the space into cells; the points of a cell are cut, each time along the axis of widest spread, into
blocks of ``BLOCK`` points, and a block knows the box of its points along the first axes.  A block's own points
bound the neighbour distance of each of them.  A point then asks only the other blocks whose box lies within
its own bound (inclusive, so that ties by id are found), and only the point travels, not its block; the answers
are its nearest rows there within the bound.

Nothing is compared all against all, no group is held whole, and no point has a cap on its partners: a cell
of any size is many blocks, and a block that very many others ask is dealt over several tasks.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce
from operator import add
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import growing, passing, shuffle_partitions, stored

#: Points of a block, blocks that a cell should have, and the most cells (their splits travel with the tasks).
BLOCK = 1024
CELL_BLOCKS = 16
MOST_CELLS = 512
#: Sample points of a cell, blocks that are cut from one another at a time, and axes of a box.
SAMPLE = 32
CUT_BLOCKS = 64
AXES = 8
#: Blocks that ask a block in one task.
PARTNERS = 512
#: Relative margin for the rounding of distances in bounds.
MARGIN = 1e-9

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_lock, _inside = Lock(), []


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, the components added from first to last."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        gap = x[:, j] - y[:, j]
        total += gap * gap
    return total


def rough(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """All squared distances by one matrix product, and a bound of their rounding error."""
    centre = y.mean(axis=0)
    x, y = x - centre, y - centre
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    slack = MARGIN * (xx.max(initial=0.0) + yy.max(initial=0.0)) + 1e-300
    return np.maximum(xx[:, None] + yy[None, :] - 2 * (x @ y.T), 0.0), slack


class Block:
    """Points of a packed row: vectors, and for each its least ids in order."""

    def __init__(self, v: bytes, sizes: pa.Array, ids: pa.Array, dims: int):
        self.v = np.frombuffer(v, np.float64).reshape(-1, dims)
        size = np.asarray(sizes, np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.ids = np.asarray(ids)


class Best:
    """The k + 1 nearest rows so far of each point of a block, by distance, then id."""

    def __init__(self, block: Block, k: int, limit: np.ndarray | None = None):
        self.block, self.k = block, k
        self.row = np.zeros(0, np.int64)
        self.gap = np.zeros(0)
        self.ids = block.ids[:0]
        self.limit = np.full(len(block.v), np.inf) if limit is None else limit.copy()

    def look_at(self, other: Block) -> None:
        """Take over the rows of another block that are near enough."""
        about, slack = rough(self.block.v, other.v)
        if len(other.v) > self.k + 1:
            near = np.partition(about, self.k, axis=1)[:, self.k]
            limit = np.minimum(self.limit, near + slack)
        else:
            limit = self.limit
        row, point = np.nonzero(about <= (limit + slack)[:, None])
        gap = squared(self.block.v[row], other.v[point])
        good = gap <= self.limit[row]
        row, point, gap = row[good], point[good], gap[good]
        size = np.diff(other.first)[point]
        at = np.repeat(other.first[point] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        self._merge(np.repeat(row, size), np.repeat(gap, size), other.ids[at])

    def _merge(self, row, gap, ids) -> None:
        row, gap = np.concatenate([self.row, row]), np.concatenate([self.gap, gap])
        ids = np.concatenate([self.ids, ids])
        _, rank = np.unique(ids, return_inverse=True)
        order = np.lexsort((rank.reshape(-1), gap, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = order[place <= self.k]
        self.row, self.gap, self.ids = row[place <= self.k], gap[keep], ids[keep]
        last = place == self.k
        self.limit[row[last]] = gap[order][last]


def _vector(df: DataFrame, features: list[str]) -> F.Column:
    return F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features])   # -0.0 becomes 0.0


def points_of(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its k + 1 least ids, so that copies meet before any comparison.

    Vectors are grouped and joined with their hash before them: a sort compares the hash, and the components only
    where it ties."""
    by_id = Window.partitionBy("_h", "v").orderBy("id")
    few = rows.withColumn("_h", F.xxhash64("v")).withColumn("_rn", F.row_number().over(by_id)).where(F.col("_rn") <= k + 1)
    return few.groupBy("_h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", "ids")


class Cells:
    """Principal axes of a sample, and a tree of its median splits along them."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.dims, self.depth = sample.shape[1], depth
        self.centre = sample.mean(axis=0)
        with np.errstate(over="ignore", invalid="ignore"):
            spread = (sample - self.centre).T @ (sample - self.centre)
        self.axes = np.eye(self.dims)
        if np.isfinite(spread).all():
            self.axes = np.linalg.eigh(spread)[1][:, ::-1]
        self.axes = np.ascontiguousarray(self.axes[:, :AXES])
        self.axis, self.cut = np.zeros(2 ** (depth + 1) - 1, np.int64), np.zeros(2 ** depth - 1)
        parts = [self.project(sample)[0]]
        for node in range(len(self.axis)):
            x = parts[node]
            self.axis[node] = widest(x) if len(x) else 0
            if node < len(self.cut):
                at = x[:, self.axis[node]]
                self.cut[node] = np.median(at) if len(at) else 0.0
                parts += [x[at <= self.cut[node]], x[at > self.cut[node]]]

    def __len__(self):
        return 2 ** self.depth

    def project(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates along the axes, and a bound of their rounding error for each point."""
        with np.errstate(over="ignore"):
            size = np.sqrt(np.einsum("ij,ij->i", v, v)) + np.sqrt(self.centre @ self.centre)
        return (v - self.centre) @ self.axes, MARGIN * size

    def locate(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each point, and its coordinate along the cell's widest axis."""
        x, every = self.project(v)[0], np.arange(len(v))
        node = np.zeros(len(v), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[every, self.axis[node]] > self.cut[node])
        return node - len(self.cut), x[every, self.axis[node]]


def widest(x: np.ndarray) -> int:
    """The axis of widest spread."""
    return int(x.std(axis=0).argmax())


def cuts_of(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of blocks of ``most`` points, cut in halves along the axis of widest spread."""
    ready, left = [], [np.arange(len(x))]
    while left:
        rows = left.pop()
        if len(rows) <= most:
            ready.append(rows)
            continue
        half = most * ((len(rows) + most - 1) // most // 2)
        order = np.argpartition(x[rows, widest(x[rows])], half)
        left += [rows[order[half:]], rows[order[:half]]]
    return ready


def pivots_of(points: DataFrame, n: int, dims: int) -> Cells:
    """Cells laid out by points of least hash, about ``SAMPLE`` a cell."""
    depth = int(np.log2(min(MOST_CELLS, max(1, n // (CELL_BLOCKS * BLOCK)))))
    size = SAMPLE * max(2 ** depth, 32)
    hashed = points.select("v", F.xxhash64("v").alias("h"))
    if n > 8 * size:   # so that the tasks send a bounded number of rows
        few = hashed.where(F.col("h") < F.lit(int(-2 ** 63 + 2 ** 64 * 4 * size / n)))
        hashed = few if few.count() >= size else hashed
    return Cells(np.array([r["v"] for r in hashed.orderBy("h", "v").limit(size).collect()], np.float64).reshape(-1, dims),
                 depth)


def _flat(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def packed(points: DataFrame, pivots: Cells, id_type: T.DataType) -> DataFrame:
    """Blocks: cell, box along the axes (low, high), vectors and ids."""
    dims, kind, most = pivots.dims, id_type.simpleString(), BLOCK

    def locate(batches):
        for batch in batches:
            if batch.num_rows:
                cell, along = pivots.locate(_flat(batch.column(0), dims))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(along)],
                                                 names=["v", "ids", "cell", "along"])

    located = points.mapInArrow(locate, f"v array<double>, ids array<{kind}>, cell int, along double")
    dealt = located.repartitionByRange(shuffle_partitions(points.sparkSession), "cell", "along", "v") \
        .sortWithinPartitions("cell", "along", "v")

    def pack(batches):
        from pyspark import TaskContext

        part, made, kept, held, cell = TaskContext.get().partitionId() << 32, 0, [], 0, None

        def blocks():
            nonlocal made
            table = pa.Table.from_batches(kept).combine_chunks()
            v, ids = _flat(table.column("v").chunk(0), dims), table.column("ids").chunk(0)
            x, slack = pivots.project(v)
            for rows in cuts_of(x, most):
                some = ids.take(pa.array(rows))
                yield pa.RecordBatch.from_pydict({
                    "block": [part + made], "cell": [cell], "low": [(x[rows] - slack[rows, None]).min(axis=0)],
                    "high": [(x[rows] + slack[rows, None]).max(axis=0)], "v": [v[rows].tobytes()],
                    "sizes": [some.value_lengths()], "ids": [some.flatten()]}, schema=schema)
                made += 1

        schema = None
        for batch in batches:
            if schema is None:
                real = pa.list_(pa.float64())
                schema = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("low", real), ("high", real),
                                    ("v", pa.binary()), ("sizes", pa.list_(pa.int32())),
                                    ("ids", pa.list_(batch.schema.field("ids").type.value_type))])
            cells = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and kept and cells[a] != cell:
                    yield from blocks()
                    kept, held = [], 0
                while a < b:
                    cell = int(cells[a])
                    room = min(CUT_BLOCKS * most - held, b - a)
                    kept.append(batch.slice(a, room))
                    a, held = a + room, held + room
                    if held == CUT_BLOCKS * most:
                        yield from blocks()
                        kept, held = [], 0
        if kept:
            yield from blocks()

    return stored(dealt.mapInArrow(pack, f"block long, cell int, low array<double>, high array<double>, v binary, "
                                         f"sizes array<int>, ids array<{kind}>"), "knn-blocks")


def _lists(best: Best, kind: pa.DataType) -> pa.ListArray:
    """near array<struct(gap, id)> of each point of a block."""
    bounds = np.searchsorted(best.row, np.arange(len(best.block.v) + 1)).astype(np.int32)
    near = pa.StructArray.from_arrays([pa.array(best.gap), pa.array(best.ids, kind)], names=["gap", "id"])
    return pa.ListArray.from_arrays(pa.array(bounds), near)


def own_neighbours(blocks: DataFrame, k: int, dims: int) -> DataFrame:
    """The blocks with each point's least id (vids), its k + 1 nearest rows in the block (near), the squared
    distance that none of its nearest rows exceeds (limits; infinite where the block has fewer rows) and the
    greatest such distance (radius)."""
    kind = blocks.schema["ids"].dataType

    def run(batches):
        for batch in batches:
            kept = batch.schema.names
            for i, r in enumerate(batch.select(["v", "sizes", "ids"]).to_pylist()):
                best = Best(mine := Block(r["v"], r["sizes"], r["ids"], dims), k)
                best.look_at(mine)
                id_kind = batch.schema.field("ids").type.value_type
                near, one = _lists(best, id_kind), pa.array([0, len(mine.v)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, 1).columns, pa.ListArray.from_arrays(one, pa.array(mine.ids[mine.first[:-1]], id_kind)),
                     pa.ListArray.from_arrays(one, near), pa.array([best.limit.tobytes()], pa.binary()),
                     pa.array([float(np.sqrt(best.limit.max(initial=0.0)))])],
                    names=[*kept, "vids", "near", "limits", "radius"])

    near = T.StructType().add("gap", T.DoubleType()).add("id", kind.elementType)
    known = T.StructType(list(blocks.schema.fields)).add("vids", kind).add("near", T.ArrayType(T.ArrayType(near))) \
        .add("limits", T.BinaryType()).add("radius", T.DoubleType())
    return stored(blocks.mapInArrow(run, known), "knn-own")


def partners_of(blocks: DataFrame, k: int, dims: int, pivots: int) -> DataFrame:
    """(block, other, low, high): pairs of different blocks that may hold neighbours, with the box of the other."""
    if "radius" not in blocks.columns:
        blocks = own_neighbours(blocks, k, dims)
    axes = range(width := min(dims, AXES))
    cells = blocks.groupBy("cell").agg(*[F.min(F.col("low")[i]).alias(f"low{i}") for i in axes],
                                       *[F.max(F.col("high")[i]).alias(f"high{i}") for i in axes]).collect()  # one per cell
    number = np.array([r["cell"] for r in cells], np.int32)
    least, most = (np.array([[r[f"{side}{i}"] for i in axes] for r in cells]) for side in ("low", "high"))

    def reach(batches):
        for batch in batches:
            low, high = (_flat(batch.column(i), width) for i in (1, 2))
            radius = batch.column(3).to_numpy() * (1 + MARGIN)
            for i in range(batch.num_rows):
                gap = np.maximum(np.maximum(least - high[i], low[i] - most), 0.0)
                near = number[~((gap * gap).sum(axis=1) > radius[i] ** 2)]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(np.full(len(near), i))) for c in batch.columns]
                                                 + [pa.array(near)], names=["block", "low", "high", "radius", "cell"])

    wanted = blocks.select("block", "low", "high", "radius").mapInArrow(
        reach, "block long, low array<double>, high array<double>, radius double, cell int").alias("a")
    other = blocks.select(F.col("block").alias("other"), "cell", "low", "high").alias("b")
    gaps = [F.greatest(F.col("b.low")[i] - F.col("a.high")[i], F.col("a.low")[i] - F.col("b.high")[i], F.lit(0.0)) for i in axes]
    return (wanted.join(other, "cell").where((F.col("block") != F.col("other")) & (
        F.sqrt(reduce(add, [g * g for g in gaps])) <= F.col("radius") * (1 + MARGIN)))
        .select("block", "other", "b.low", "b.high"))


def asked(blocks: DataFrame, pairs: DataFrame, cells: Cells, kind: str) -> DataFrame:
    """(other, part, asker, v, limits, ids): of each pair the points of the block whose bound reaches the box of
    the other, with their vectors, limits and least ids."""
    dims, width = cells.dims, cells.axes.shape[1]
    box = "array<double>"
    mine = blocks.select("block", F.lit(-1).cast("long").alias("other"), F.lit(0).alias("part"), F.lit(None).cast(box).alias("low"),
                         F.lit(None).cast(box).alias("high"), "v", "limits", F.col("vids").alias("ids"))
    theirs = pairs.select("block", "other", "part", "low", "high", F.lit(None).cast("binary").alias("v"),
                          F.lit(None).cast("binary").alias("limits"), F.lit(None).cast(f"array<{kind}>").alias("ids"))
    dealt = mine.unionAll(theirs).repartition("block").sortWithinPartitions("block", "other")

    def run(batches):
        v = limit = ids = x = reach = None
        for batch in batches:
            names = ["other", "part", "asker", "v", "limits", "ids"]
            out = {name: [] for name in names}
            for r in batch.to_pylist():
                if r["other"] < 0:
                    v, limit = np.frombuffer(r["v"], np.float64).reshape(-1, dims), np.frombuffer(r["limits"], np.float64)
                    x, slack = cells.project(v)
                    reach, ids = (np.sqrt(limit) * (1 + MARGIN) + slack) ** 2, np.asarray(r["ids"])
                    continue
                gap = np.maximum(np.maximum(np.array(r["low"])[:width] - x, x - np.array(r["high"])[:width]), 0.0)
                rows = np.flatnonzero(~(np.einsum("ij,ij->i", gap, gap) > reach))
                if len(rows):
                    for name, value in zip(names, (r["other"], r["part"], r["block"], v[rows].tobytes(),
                                                   limit[rows].tobytes(), ids[rows])):
                        out[name].append(value)
            if out["other"]:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("other", pa.int64()), ("part", pa.int32()), ("asker", pa.int64()), ("v", pa.binary()),
                    ("limits", pa.binary()), ("ids", batch.schema.field("ids").type)]))

    return dealt.mapInArrow(run, f"other long, part int, asker long, v binary, limits binary, ids array<{kind}>")


def nearest_rows(blocks: DataFrame, k: int, cells: Cells, id_type: T.DataType) -> DataFrame:
    """(vid, near array<struct(gap, id)>): the k + 1 nearest rows of each point, named by its least id, itself
    and its copies included; gap is the squared distance."""
    dims, kind, most = cells.dims, id_type.simpleString(), BLOCK
    pairs = stored(partners_of(blocks, k, dims, len(cells)), "knn-pairs")
    parts = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    asks = asked(blocks, pairs.join(parts, "other").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")),
                 cells, kind)
    payload = ["v", "limits", "ids", "sizes"]
    mine = blocks.select(F.col("block").alias("other"), "v", F.lit(None).cast("binary").alias("limits"), "ids", "sizes") \
        .join(parts, "other").select("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                     F.lit(-1).cast("long").alias("asker"), *payload)
    theirs = asks.select("other", "part", "asker", "v", "limits", "ids", F.lit(None).cast("array<int>").alias("sizes"))
    dealt = mine.unionAll(theirs).repartition("other", "part").sortWithinPartitions("other", "part", "asker")

    def run(batches):
        block, held, kind_of = None, [], None

        def answers():
            ids = np.concatenate([np.asarray(r["ids"]) for r in held])
            points = Block(b"".join(r["v"] for r in held), np.ones(len(ids), np.int64), ids, dims)
            best = Best(points, k, np.frombuffer(b"".join(r["limits"] for r in held), np.float64))
            best.look_at(block)
            some = np.flatnonzero(np.bincount(best.row, minlength=len(ids)))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[some], kind_of), _lists(best, kind_of).take(pa.array(some))], names=["vid", "near"])

        for batch in batches:
            kind_of = batch.schema.field("ids").type.value_type
            for r in batch.to_pylist():
                if r["asker"] < 0:
                    if held:
                        yield answers()
                    block, held = Block(r["v"], r["sizes"], r["ids"], dims), []
                    continue
                held.append(r)
                if sum(len(x["ids"]) for x in held) >= most:
                    yield answers()
                    held = []
        if held:
            yield answers()

    found = dealt.mapInArrow(run, f"vid {kind}, near array<struct<gap:double,id:{kind}>>")
    own = blocks.select(F.inline(F.arrays_zip("vids", "near"))).toDF("vid", "near")
    return own.unionAll(found).groupBy("vid").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))


@contextmanager
def block_batches(spark):
    """Small Arrow batches, since a row is a whole block; joins may run side by side, the last one out sets the
    session back."""
    with _lock:
        if not _inside:
            _inside.append(spark.conf.get(_BATCH, "10000"))
            spark.conf.set(_BATCH, "64")
        _inside.append(None)
    try:
        yield
    finally:
        with _lock:
            _inside.pop()
            if len(_inside) == 1:
                spark.conf.set(_BATCH, _inside.pop())


def knn_join(df: DataFrame, features: list[str], k: int, id_col: str) -> DataFrame:
    """(id, rank, neighbour, distance): for every row its ``k`` nearest other rows by Euclidean distance of
    ``features``, ties by id; fewer where the table has fewer.

    Rows with a null id, or a null or non-finite feature, are left out; of rows of equal id the least vector
    counts.  The id is a number or a string.
    """
    spark = df.sparkSession
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), _vector(df, features).alias("v")).where(F.col("id").isNotNull() & fine)
    rows = stored(rows.groupBy("id").agg(F.min("v").alias("v")), "knn-rows")
    points = stored(points_of(rows, k), "knn-points")
    dims, kind = len(features), rows.schema["id"].dataType
    n = points.count()
    if not n:
        return spark.createDataFrame([], T.StructType([
            T.StructField(id_col, kind), T.StructField("rank", T.IntegerType()), T.StructField("neighbour", kind),
            T.StructField("distance", T.DoubleType())]))
    cells = pivots_of(points, n, dims)
    with passing(spark) as keep, block_batches(spark):
        blocks = packed(points, cells, kind)
        near = keep(stored(nearest_rows(own_neighbours(blocks, k, dims), k, cells, kind), "knn-near"))
    by_hash = points.select(F.xxhash64("v").alias("_h"), "v", F.col("ids")[0].alias("vid"))
    named = rows.withColumn("_h", F.xxhash64("v")).join(growing(by_hash, n), ["_h", "v"]).select("id", "vid")
    own = named.join(growing(near, n), "vid").select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return own.select(F.col("id").alias(id_col), F.posexplode("near").alias("pos", "x")).select(
        id_col, (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("neighbour"),
        F.sqrt("x.gap").alias("distance"))
