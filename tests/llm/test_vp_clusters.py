"""Centroid clustering: brute force, SQL, ties, huge and broken vectors."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from callrisk.llm import oracles, queries, vp_clusters
from callrisk.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def plain(rows, k, rounds, dims, scale=256):
    """rows: (id, vector); Python integers throughout."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 2 ** 60 else int(x) * scale for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(
        f"2:{'' if kept[r][0] is None else kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    centroids = [list(kept[r][1]) for r in order[:k]]
    for turn in range(rounds + 1):
        found = []
        for i, v in kept:
            found.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)))
        if turn < rounds:
            for n in range(len(centroids)):
                mine = [v for (_, v), (_, m) in zip(kept, found) if m == n]
                if mine:
                    centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    top = (1 << 63) - 1
    inertia = {n: sum(d for d, m in found if m == n) for n in range(len(centroids))}
    return sorted((str(i), n, min(d, top), min(inertia[n], top), min(sum(inertia.values()), top),
                   tuple(map(str, centroids[n]))) for (i, _), (d, n) in zip(kept, found))


def got(df):
    return sorted((str(r[0]), *r[1:5], tuple(r[5])) for r in df.collect())


def test_equals_brute_force_and_sql(spark):
    query = queries.QUERIES["op11_vp_clusters"](spark, SF)
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, SF, "embeddings").collect()]
    want = {r[0]: (*r[1:5], hashlib.sha256(",".join(r[5]).encode()).hexdigest()) for r in plain(rows, 40, 5, 64)}
    found = {str(r.vec_id): tuple(r[1:]) for r in query.collect()}
    assert found == want and len({v[0] for v in want.values()}) > 20
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert {str(r[0]): tuple(r[1:]) for r in con.execute(oracles.ORACLE["op11_vp_clusters"]).fetchall()} == want


def test_ties_broken_and_huge_vectors(spark, empty):
    grid = [(i, [float(i % 3), float(i % 2), 0.0]) for i in range(60)]                  # many equal distances
    odd = [(100, None), (101, [1.0]), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 0.0]),
           (104, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (7, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0]),
           (105, [1e20, -1e300, 0.0]), (106, [-3e19, 2.5e19, 1e-300]), (107, [-0.001, 0.001, -2.0])]
    for rows in (grid, grid + odd, odd, odd[:5]):
        df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                   "vec_id long, embedding array<double>, cluster string, id int").repartition(4)
        for k in (1, 5, 13, 200):
            assert got(vp_clusters.cluster(df, k=k, rounds=2, dims=3)) == plain(rows, k, 2, 3)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vp_clusters.cluster(none).count() == 0


@pytest.mark.parametrize("low,high", [(-3, 4), (-1000, 1000)])
def test_tree_finds_the_nearest_with_the_smaller_number(low, high):
    rng = np.random.default_rng(high)
    centroids = rng.integers(low, high, (57, 2))
    x = rng.integers(low, high, (3000, 2))
    number, best = vp_clusters.Tree(centroids).nearest(x)
    gaps = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (number == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()


def test_search_prunes_far_nodes():
    centroids = np.arange(64)[:, None] * 1000
    tree, seen = vp_clusters.Tree(centroids), []
    measure = vp_clusters.squared
    vp_clusters.squared = lambda x, c: seen.append(len(x)) or measure(x, c)
    try:
        tree.nearest(np.arange(64)[:, None] * 1000 + 3)
    finally:
        vp_clusters.squared = measure
    assert sum(seen) < 64 * 64 / 3
