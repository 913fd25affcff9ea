"""Merged transforms and exact removal against direct computations."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from callrisk.llm import bwt_dedup, exchange, queries

from .conftest import rows_of


def brute(rows, length=400):
    body = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(hash(b[k:k + length]) for _, b in body for k in range(len(b) - length + 1))
    out = []
    for i, b in body:
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - length + 1):
            if count[hash(b[k:k + length])] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in queries.repeats_digest(bwt_dedup.remove_repeats(df, **kw)).collect()), key=str)


def planted(seed=7):
    """Passages just above and below the length, at both ends, overlapping themselves, and periodic runs."""
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p = [word(n) for n in (399, 400, 401, 460, 900, 3000)]
    out = []
    for k in range(60):
        text = word(r.randrange(0, 900))
        for _ in range(r.randrange(0, 3)):
            x = r.choice(p)
            a = r.randrange(0, 60)
            text += x[a * r.randrange(0, 2):] + word(r.randrange(0, 300))
        out.append((k, text))
    out += [(100, "a" * 400), (101, "b" * 401), (102, "cd" * 300), (103, "x" * 390 + word(30)), (104, p[4]), (105, p[4][1:]),
            (106, p[5][:1500] + p[5][1400:]), (107, "é" * 500), (108, p[0] + "!" + p[0]), (109, p[1] + p[1]),
            (110, "-" * 700 + "\n" + "-" * 405)]
    return out


@pytest.mark.parametrize("shard", [1 << 12, 1 << 23])
def test_planted_passages(spark, monkeypatch, shard):
    monkeypatch.setattr(bwt_dedup, "SHARD_BYTES", shard)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df) == brute(rows)


def test_documents(documents):
    assert run(documents) == brute(rows_of(documents))


def test_edges_and_short_length(edge, empty, spark):
    assert run(edge) == brute(rows_of(edge))
    assert run(empty) == []
    with pytest.raises(ValueError):
        bwt_dedup.remove_repeats(edge, length=100)


def test_transform_is_the_sorted_suffixes():
    r = np.random.default_rng(2)
    symbols = r.integers(0, 4, 200).astype(np.uint64)
    symbols[-1] = 0
    order, bwt = bwt_dedup.transform(symbols)
    ends = np.flatnonzero(symbols == 0)
    text = [int(s) + 1000 if s else int(np.searchsorted(ends, k)) for k, s in enumerate(symbols)]
    assert order.tolist() == sorted(range(200), key=lambda k: text[k:])
    assert bwt.tolist() == [int(symbols[k - 1]) if k else 0 for k in order]


def test_interleave_orders_all_suffixes_and_finds_common_prefixes(spark, monkeypatch, documents):
    monkeypatch.setattr(bwt_dedup, "SHARD_BYTES", 1 << 16)
    table = exchange.ShardTable(bwt_dedup._state(documents, 400, "doc_id", "text"))
    blocks = bwt_dedup.merge(table, 3, 4)
    seen = []
    for row in bwt_dedup._with(table, ["bwt", "suffixes"], blocks=blocks).collect():
        shard = bwt_dedup._merged(row.asDict(recursive=True), 3)
        place = exchange.unpack(row["suffixes"], "<u4").astype(int)
        symbols = np.zeros(len(place) + 3, np.uint64)
        symbols[:-3][(place - 1) % len(place)] = shard.bwt
        for k in range(len(place)):
            word = symbols[place[k]:place[k] + 3].tolist()
            seen.append((tuple(word), int(shard.rank[k]), int(shard.lcp[k])))
    table.drop()
    whole = [s for s in seen if 0 not in s[0]]
    count = Counter(s[0] for s in whole)
    assert all((lcp == 3) == (count[w] > 1) for w, _, lcp in whole)
    assert max(count.values()) > 1
    alive = sorted((w, rank) for w, rank, lcp in whole if lcp == 3)
    assert [r for _, r in alive] == sorted(r for _, r in alive)
    assert len({r for _, r in alive}) == len({w for w, _ in alive})
