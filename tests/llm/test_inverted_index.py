"""Positional index against a direct search."""

import re

import pytest
from pyspark.sql import functions as F

from callrisk.llm import inverted_index, queries
from callrisk.sources.tables import read_table

from .conftest import SF, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            x = words(text)
            n = min(window, len(x))
            for phrase in {tuple(x[k:k + n]) for k in range(len(x) - n + 1)} if x else ():
                for k in range(len(w) - n + 1):
                    if w[k] == phrase[0] and tuple(w[k:k + n]) == phrase:
                        hit |= set(range(k, k + n))
                        found.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def run(docs, items, **kw):
    index = inverted_index.build_index(docs)
    got = inverted_index.report(index, inverted_index.search(index, items, **kw)).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r.item_ids))) for r in got), key=str)


def test_documents_against_benchmark(spark, documents):
    items = read_table(spark, SF, "benchmark")
    found = run(documents, items)
    assert found == brute(rows_of(documents), [(r.item_id, r.text) for r in items.collect()])
    assert any(n for _, _, n, _ in found)


def test_edge_texts_and_items(spark, edge, empty):
    items = [(1, "the cat"), (2, "word " * 12), (3, None), (4, ""), (5, "ONE two three four five six seven eight nine ten"),
             (6, "the cat"), (7, "one Two three four five six seven eight nine ten eleven"), (8, "missing here")]
    df = spark.createDataFrame(items, "item_id long, text string")
    assert run(edge, df) == brute(rows_of(edge), items)
    assert run(empty, df) == []
    assert all(n == 0 for _, _, n, _ in run(edge, df.limit(0)))


def test_blocks_of_items_meet_in_one_row(spark, documents, monkeypatch):
    items = read_table(spark, SF, "benchmark").repartition(3)
    assert run(documents, items) == brute(rows_of(documents), [(r.item_id, r.text) for r in items.collect()])


def test_broadcast_is_bounded(spark, documents, monkeypatch):
    """Blocks go out in passes of bounded size, whatever the number of test items."""
    monkeypatch.setattr(inverted_index, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(inverted_index, "BROADCAST_BYTES", 20_000)
    items = read_table(spark, SF, "benchmark").repartition(2)
    blocks = inverted_index.test_phrases(items, 10)
    numbered = blocks.withColumn("block", F.monotonically_increasing_id()).cache()
    passes = inverted_index._passes(numbered)
    assert len(passes) > 1 and sorted(n for p in passes for n in p) == sorted(r.block for r in numbered.collect())
    assert run(documents, items) == brute(rows_of(documents), [(r.item_id, r.text) for r in items.collect()])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b c"), (2, "a b c"), (3, "a x x x b c"), (4, "c b a")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    assert [r[0] for r in run(docs, items) if r[2]] == [2]
    assert [r[0] for r in run(docs, items, slack=1) if r[2]] == [1, 2]


def test_proximity_credits_the_matching_document(spark):
    """The start of a shifted match may lie in the document before the matching one."""
    docs = spark.createDataFrame([(1, "x y z w v a a a b b b"), (2, "a c b")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    assert [(r[0], r[3]) for r in run(docs, items, slack=2) if r[2]] == [(2, (9,))]
    first = spark.createDataFrame([(1, "c a b a b")], "doc_id long, text string")   # start before the shard
    assert [r[0] for r in run(first, items, slack=3) if r[2]] == [1]


def test_query_columns(spark):
    df = queries.QUERIES["op5_decontamination"](spark, SF)
    assert df.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert df.where("n_items = 0").first()["items_sha256"].startswith("e3b0c442")
