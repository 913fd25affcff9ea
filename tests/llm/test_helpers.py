"""Ragged helpers, the key exchange and the hash sample against plain computations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callrisk.llm import arrays, exchange, tasks


def test_utf8_of_slices_nulls_and_wide_strings():
    column = pa.array(["ab", None, "", "é", "xyz"])
    for kind in (pa.string(), pa.large_string()):
        data, offsets = arrays.utf8(column.cast(kind).slice(1, 3))
        assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 0, 2]
    assert arrays.utf8(pa.nulls(2))[1].tolist() == [0, 0, 0]


def test_range_hash_depends_on_content_alone():
    data = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    h = arrays.RangeHash(data)
    starts, ends = np.array([0, 3, 6, 9, 0, 1]), np.array([3, 6, 9, 12, 6, 4])
    got = h(starts, ends).tolist()
    assert got[0] == got[1] == got[3] and len({got[0], got[2], got[4], got[5]}) == 4


def test_words_never_cross_rows_and_short_rows_are_one_shingle():
    rows = [b"a b", b"", b"  c", b"d e f", b"g"]
    data = np.frombuffer(b"".join(rows), np.uint8)
    offsets = arrays.offsets_of(np.array([len(r) for r in rows]))
    starts, ends, n = arrays.word_ranges(data, offsets, arrays.NOT_SPACE)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [b"a", b"b", b"c", b"d", b"e", b"f", b"g"]
    assert n.tolist() == [2, 0, 1, 3, 1]
    _, count = arrays.shingle_hashes(arrays.RangeHash(data)(starts, ends), n, 2)
    assert count.tolist() == [1, 0, 1, 2, 1]


@pytest.mark.parametrize("width", [1, 2])
def test_exchange_sums_ranks_and_first_shards(spark, width):
    rng = np.random.default_rng(4)
    pool = np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2))
    made, sent = [], {}
    for shard in range(5):
        keys = np.sort(rng.choice(pool, 25, replace=False))
        keys = keys if width == 1 else np.stack([keys, keys % np.uint64(7)], axis=1)
        counts = rng.integers(0, 3, 25)
        sent[shard] = (keys, counts)
        made += exchange.request(shard, 1, keys, counts, 3)
    df = spark.createDataFrame([tuple(r.values()) for r in made], exchange.REQUEST)
    key = lambda k: int(k) if width == 1 else tuple(map(int, k))
    total, first = {}, {}
    for shard, (keys, counts) in sent.items():
        for k, c in zip(keys, counts):
            total[key(k)] = total.get(key(k), 0) + int(c)
            if c > 0:
                first.setdefault(key(k), shard)
    for extra in ("first", "rank"):
        answers = exchange.summed(df, extra, width)
        ranks = {}
        for r in exchange.by_shard(answers, "a").collect():
            got = exchange.answered(r["a"], 1, 2)
            for k, (n, x) in zip(sent[r["shard"]][0], got.tolist()):
                assert n == total[key(k)]
                if extra == "first":
                    assert x == (first.get(key(k)) == r["shard"])
                else:
                    assert (x > 0) == (n > 1) and ranks.setdefault(key(k), x) == x
        alive = [ranks[k] for k in sorted(ranks) if ranks[k]]
        assert alive == sorted(alive)
        assert answers.agg(F.sum("distinct")).first()[0] == len(first)


def test_hash_sample_is_the_least_hashes(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = {r.k for r in tasks.least_by_hash(df, "k", 50).collect()}
    want = {r.k for r in df.orderBy(F.xxhash64("k")).limit(50).collect()}
    assert got == want and tasks.least_by_hash(df.limit(0), "k", 5).count() == 0


def test_id_ranges_are_balanced_and_in_order(spark):
    df = spark.range(1000)
    bounds = tasks.id_bounds(df, 4)
    sizes = df.groupBy(tasks.range_of(F.col("id"), bounds).alias("r")).count().orderBy("r").collect()
    assert [r["r"] for r in sizes] == [0, 1, 2, 3] and max(r["count"] for r in sizes) < 500
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(tasks.range_of(F.col("id"), bounds)).first()[0] == -1


@pytest.mark.parametrize("dealt", [2, 4, 37])
def test_id_ranges_are_as_many_as_asked_for(spark, dealt):
    """A session that deals range sorts over more partitions gives no more ranges."""
    kind = type(spark.range(0))
    own = kind.repartitionByRange
    try:
        kind.repartitionByRange = lambda self, n, *c: own(self, max(n, dealt), *c)
        bounds = tasks.id_bounds(spark.range(1000), 4)
    finally:
        kind.repartitionByRange = own
    assert len(bounds) == 3
    sizes = spark.range(1000).groupBy(tasks.range_of(F.col("id"), bounds).alias("r")).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 500


def test_batches_are_bounded_by_bytes_where_the_plan_runs(spark):
    """Also in a plan that runs after the operator has returned it."""
    df = tasks.texts(spark.range(200).repartition(1).selectExpr("id", "repeat('x', 1000000) AS text"), "id", "text")
    sizes = tasks.map_arrow(df, lambda b: iter([{"n": [b.nbytes]}]), [("n", "long")], None)
    assert max(r.n for r in sizes.collect()) < 2 * arrays.BATCH_BYTES
