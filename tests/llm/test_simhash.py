"""SimHash fingerprints, covering masks and groups against direct computation."""

import random
from collections import Counter

import numpy as np
import xxhash

from callrisk.llm import queries, simhash
from callrisk.llm.components import components

from .conftest import rows_of


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        bits.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(grams))


def groups(rows, radius=4):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(df):
    return sorted((tuple(r) for r in queries.simhash_groups(df).collect()), key=str)


def test_documents(documents):
    assert run(documents) == groups(rows_of(documents))


def test_edges(edge, empty):
    assert run(edge) == groups(rows_of(edge))
    assert run(empty) == []


def test_every_pair_within_the_radius_shares_a_mask():
    for draw in range(3):
        masks = [m % (1 << 64) for m in simhash.covering_masks(4, draw)]
        rng = random.Random(draw)
        for _ in range(2000):
            flip = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            assert any(flip & m == 0 for m in masks)


def test_links_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 7), replace=False)) for _ in range(300)})
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)
    got = {r.node: r.root for r in components(found).collect()}
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            for y in fps:
                if (x ^ y).bit_count() <= 2 and root[y] < root[x]:
                    root[x], changed = root[y], True
    assert {f: got.get(f, f) for f in fps} == root


def test_components_of_paths_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (200, 150), (150, 199), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 199: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
