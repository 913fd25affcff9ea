"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of its document's shingle hashes.  For radius r every bit position
gets a random vector of r + 1 bits; each non-zero vector v of r + 1 bits gives one mask, the positions
whose vector has odd inner product with v.  Two fingerprints that differ in at most r positions agree on
all bits of some mask (the differing positions' vectors span at most r dimensions, so some v is
orthogonal to all), so they share a bucket of that mask's table: no pair within the radius is missed.

Distinct fingerprints alone enter the tables: copies meet before.  A bucket above ``BUCKET`` members is
split again by the masks of a fresh random draw (the guarantee holds inside the bucket too) until it is
small; inside a bucket distances are exact, and each member sends one link per neighbour group, not one
per pair.

Defined results: null and empty texts have no words and fingerprint zero, which links like any other;
fewer words than a shingle give one shingle of all words; a tie of set and clear bits is 0; repeated
rows and null ids keep a row each (a null id is never the least id unless all are null); extra columns
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import offsets_of, utf8
from .components import components
from .tasks import map_arrow, texts, written

#: Members of a bucket that are compared at once.
BUCKET = 1024
SEED = 42


def _fingerprint(text: bytes, size: int) -> int:
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    at = offsets_of(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED)
                       for a, b in zip(at[:len(words) - size + 1].tolist(), (at[size:] - 1).tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(majority).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row: the 64 bits as a signed number."""
    def run(batch):
        data, offsets = utf8(batch.column(1))
        raw = data.tobytes()
        yield {id_col: batch.column(0),
               "fp": pa.array([_fingerprint(raw[a:b], shingle)
                               for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.int64())}

    return map_arrow(texts(df, id_col, text_col), run, [(id_col, df.schema[id_col].dataType), ("fp", "long")])


def covering_masks(radius: int, draw: int = 0) -> list[int]:
    """2 ** (radius + 1) - 1 masks as signed 64-bit numbers."""
    vectors = np.random.default_rng(1000 + draw).integers(0, 2 << radius, 64).tolist()
    masks = []
    for v in range(1, 2 << radius):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def links(fps: DataFrame, radius: int = 4, fp_col: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints within ``radius`` bits, enough to connect every pair
    of them; both columns are fingerprints."""
    members = fps.select(F.col(fp_col).alias("fp")).distinct().select("fp", F.lit(0).cast("long").alias("bucket"))
    members = written(members, "fingerprints")
    out, draw = None, 0
    while True:
        table = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("m"))
                                    for t, m in enumerate(covering_masks(radius, draw)))))
        keyed = (members.withColumn("x", table)
                 .select("fp", F.xxhash64("bucket", "x.t", F.col("fp").bitwiseAND(F.col("x.m"))).alias("bucket")))
        sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        sizes = written(sizes, "bucket-sizes")
        small = keyed.join(sizes.where(F.col("n") <= BUCKET).select("bucket"), "bucket")
        found = map_arrow(small.groupBy("bucket").agg(F.collect_list("fp").alias("fps")).select("fps"),
                          _compare(radius), [("a", "long"), ("b", "long")], None).distinct()
        out = found if out is None else out.unionAll(found)
        if sizes.where(F.col("n") > BUCKET).isEmpty():
            return out.distinct()
        members = written(keyed.join(sizes.where(F.col("n") > BUCKET).select("bucket"), "bucket")
                          .select("fp", "bucket"), "large-buckets")
        draw += 1


def _compare(radius: int):
    """Exact distances in each bucket; a member links to the first one of its neighbour group."""
    def run(batch):
        a, b = [], []
        column = batch.column(0)
        bounds = column.offsets.to_numpy()
        flat = column.values.to_numpy()
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            fps = np.sort(flat[x:y])
            near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius
            # neighbour lists to a forest: keep taking the least label around each member
            label = np.arange(len(fps))
            while True:
                new = np.where(near, label[None, :], len(fps)).min(axis=1)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved = label != np.arange(len(fps))
            a.append(fps[moved])
            b.append(fps[label[moved]])
        yield {"a": np.concatenate(a) if a else np.zeros(0, np.int64),
               "b": np.concatenate(b) if b else np.zeros(0, np.int64)}

    return run


def near_duplicates(df: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the least id reachable over links between
    fingerprints that differ in at most ``radius`` bits."""
    docs = written(fingerprints(df, shingle, id_col, text_col), "simhash")
    return grouped(docs, radius, id_col)


def grouped(docs: DataFrame, radius: int, id_col: str = "doc_id") -> DataFrame:
    """``near_duplicates`` from written (id, fp) rows."""
    roots = components(links(docs, radius))
    least = docs.groupBy("fp").agg(F.min(id_col).alias("least"))
    rooted = (least.join(roots, least.fp == roots.node, "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    top = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(top, "root").select("fp", "component_id")
    return docs.join(by_fp, "fp").select(id_col, "fp", "component_id")
