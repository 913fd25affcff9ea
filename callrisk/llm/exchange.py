"""Exchange of packed key arrays between shards.

Shards (rows of bounded text size) ask for corpus-wide sums of 64-bit keys.  A shard sends its distinct
keys, sorted, cut into buckets by their top bits: one row per bucket with the keys and their local counts
packed as bytes.  A key, however common, is one entry per shard.  Spark groups the rows by bucket, numpy
sums each bucket, and the answers travel back to the shard in the same order, so that the shard's bucket
answers, put one after the other, line up with its sorted keys.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tasks import partitions, shared_path

REQUEST = "shard long, level int, bucket int, keys binary, counts binary"
ANSWER = "shard long, level int, bucket int, answer binary, distinct long"


def bucket_bits(spark: SparkSession) -> int:
    """Buckets follow the session's shuffle partitions, and so the size of the data."""
    return max(2, math.ceil(math.log2(4 * partitions(spark))))


def pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack(body: bytes, dtype=np.uint64) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype)


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order (a key is a number, or a row of numbers ordered column by column), the
    first index of each, and for each input key its place among them."""
    if keys.ndim == 1:
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        return distinct, first, which.reshape(-1)
    order = np.lexsort(keys.T[::-1])
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], order[new], which


def request(shard: int, level: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[dict]:
    """Rows for one shard: ``keys`` in order and distinct, ``counts`` one row of sums per key."""
    top = keys if keys.ndim == 1 else keys[:, 0]
    cuts = np.searchsorted(top, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    cuts = np.concatenate([[0], cuts, [len(keys)]])
    counts = np.asarray(counts, np.int64)
    return [{"shard": shard, "level": level, "bucket": b, "keys": keys[x:y].tobytes(), "counts": pack(counts[x:y])}
            for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]


def rows(made: list[dict]) -> pa.RecordBatch:
    kinds = [("shard", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()),
             ("counts", pa.binary())]
    return pa.RecordBatch.from_pylist(made, schema=pa.schema(kinds))


def summed(requests: DataFrame, extra: str = "", width: int = 1) -> DataFrame:
    """The answers: for each requested key the corpus-wide sums of its counts, and as a last column
    ``extra`` = "first": 1 in the one shard that counts the key as its own (the first with a count), else
    0; "rank": the key's place in the order of all keys of its level.

    ``distinct``: in one row of each bucket the number of distinct keys with a count, else 0.
    """
    def merge(table: pa.Table) -> pa.Table:
        level, bucket = table.column("level")[0].as_py(), table.column("bucket")[0].as_py()
        order = np.argsort(table.column("shard").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
        size = [len(k) // width for k in keys]
        counts = np.concatenate([unpack(x.as_py(), np.int64) for x in table.column("counts")])
        keys = np.concatenate(keys)
        distinct, _, which = distinct_keys(keys if width == 1 else keys.reshape(-1, width))
        del keys
        counts = counts.reshape(len(which), -1)
        # sums of doubles are exact here: counts of tokens stay far below 2 ** 53
        total = np.stack([np.bincount(which, c, len(distinct)).astype(np.int64) for c in counts.T], axis=1)
        columns = [total[which]]
        if extra == "first":
            first = np.full(len(distinct), len(which))
            some = np.flatnonzero(counts[:, 0] > 0)
            key, at = np.unique(which[some], return_index=True)
            first[key] = some[at]
            own = np.zeros(len(which), np.int64)
            own[first[first < len(which)]] = 1
            columns.append(own[:, None])
        elif extra == "rank":
            columns.append(np.where(total[which, 0] > 1, which + (bucket << 32) + 1, 0)[:, None])
        answer = np.split(np.concatenate(columns, axis=1), np.cumsum(size)[:-1])
        n = np.zeros(len(size), np.int64)
        n[0] = int((total[:, 0] > 0).sum())
        return pa.table({"shard": table.column("shard"), "level": pa.array([level] * len(size), pa.int32()),
                         "bucket": pa.array([bucket] * len(size), pa.int32()),
                         "answer": pa.array([pack(a) for a in answer], pa.binary()), "distinct": n})

    return requests.groupBy("level", "bucket").applyInArrow(merge, ANSWER)


def by_shard(answers: DataFrame, name: str) -> DataFrame:
    """One row per shard with its answers in (level, bucket) order."""
    return answers.groupBy("shard").agg(
        F.sort_array(F.collect_list(F.struct("level", "bucket", "answer"))).alias(name))


def answered(column, level: int, width: int) -> np.ndarray:
    """All answers of one level, in the order of the shard's sorted keys (rows x width)."""
    parts = [unpack(x["answer"], np.int64) for x in column or () if x["level"] == level]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)).reshape(-1, width)


class ShardTable:
    """A table of shard rows bucketed by shard, so that joins with answers move only the answers.

    Its files lie in the shared checkpoint folder; ``drop`` removes the table's name alone, so plans made
    before still read them.
    """

    def __init__(self, df: DataFrame):
        self.spark, self.name = df.sparkSession, f"shards_{uuid.uuid4().hex}"
        (df.write.format("parquet").option("path", shared_path(self.spark, "shards"))
         .bucketBy(partitions(self.spark), "shard").sortBy("shard").saveAsTable(self.name))
        self.table = self.spark.table(self.name)

    def read(self) -> DataFrame:
        return self.table

    def join(self, answers: DataFrame) -> DataFrame:
        return self.table.join(answers.hint("shuffle_hash"), "shard", "left")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
