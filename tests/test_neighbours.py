"""Exact nearest-neighbour join and oversampling against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callrisk.operators import neighbours as N


def brute(rows, k):
    kept = {}
    for i, v in rows:
        if i is not None and all(x is not None and np.isfinite(x) for x in v):
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for i, v in kept.items():
        gaps = sorted((sum((a - b) * (a - b) for a, b in zip(v, w)), j) for j, w in kept.items() if j != i)[:k]
        out[i] = [(j, math.sqrt(g)) for g, j in gaps]
    return out


def run(spark, rows, k, kind="long", dims=2):
    names = [f"x{j}" for j in range(dims)]
    df = spark.createDataFrame([(i, *v) for i, v in rows], f"id {kind}, " + ", ".join(f"{c} double" for c in names)) \
        .repartition(5).withColumn("block", F.lit("clash")).withColumn("rank", F.lit(7))
    out = {}
    for r in N.knn_join(df, names, k, "id").collect():
        out.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    return {i: [(j, d) for _, j, d in sorted(x)] for i, x in out.items()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "PARTNERS", 3)


@pytest.mark.parametrize("k", [1, 5])
def test_random_points(spark, small_blocks, k):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(500, 2)))]
    assert run(spark, rows, k) == brute(rows, k)


def test_ties_copies_and_string_ids(spark, small_blocks):
    """Points on a small grid: most distances tie, and a third of all rows are one point."""
    rng = np.random.default_rng(3)
    rows = [(f"r{i:03d}", [float(x) for x in (rng.integers(0, 6, 3) if i % 3 else (2, 2, 2))]) for i in range(300)]
    assert run(spark, rows, 4, "string", 3) == brute(rows, 4)


def test_defined_cases(spark):
    rows = [(1, [0.0, 0.0]), (2, [-0.0, 0.0]), (3, [1.0, None]), (None, [0.0, 0.0]), (4, [float("nan"), 1.0]),
            (5, [3.0, 4.0]), (6, [1e9, 1e9]), (6, [1e9, 1e9 + 1]), (7, [float("inf"), 0.0])]
    got = run(spark, rows, 5)
    assert got == brute(rows, 5) and got[1][0] == (2, 0.0) and len(got[5]) == 3
    assert run(spark, rows[:1], 5) == {} and run(spark, [], 5) == {}


def test_far_blocks_are_never_paired(spark, monkeypatch):
    """Clusters far apart: only blocks that span two clusters meet blocks of others."""
    monkeypatch.setattr(N, "BLOCK", 32)
    rng = np.random.default_rng(0)
    centres = [(a * 1000.0, b * 1000.0) for a in range(5) for b in range(5)]
    rows = [(i, [float(c[0] + x), float(c[1] + y)]) for i, (c, (x, y)) in
            enumerate(zip(centres * 60, rng.normal(size=(1500, 2))))]
    df = spark.createDataFrame([(i, v) for i, v in rows], "id long, v array<double>")
    points = N.points_of(df, 5)
    pivots = N.pivots_of(points, 1500, 2)
    blocks = N.packed(points, pivots, df.schema["id"].dataType)
    n, pairs = blocks.count(), N.partners_of(blocks, 5, 2, len(pivots)).count()
    assert n >= 40 and pairs < n * n / 3


def test_plan_has_no_cross_join(spark):
    df = spark.range(100).selectExpr("id", "CAST(id AS DOUBLE) AS x0")
    plans = []
    real = N.stored
    N.stored = lambda d, name: plans.append(d._jdf.queryExecution().toString()) or real(d, name)
    try:
        N.knn_join(df, ["x0"], 3, "id").count()
    finally:
        N.stored = real
    assert len(plans) >= 6 and not any(w in p for p in plans for w in ("Cartesian", "NestedLoop", "Cross"))


def test_many_cells_and_more_dimensions_than_axes(spark, small_blocks, monkeypatch):
    """Cells of a few blocks, cut a few blocks at a time; boxes know 8 of the 10 dimensions, far from zero."""
    monkeypatch.setattr(N, "CELL_BLOCKS", 2)
    monkeypatch.setattr(N, "CUT_BLOCKS", 1)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in 1e6 + rng.integers(0, 9, 10)]) for i in range(600)]
    assert run(spark, rows, 3, dims=10) == brute(rows, 3)


def test_points_that_travel_grow_with_the_table(spark, monkeypatch):
    """All vectors differ: four times the points send about four times as many to other blocks, never whole blocks."""
    monkeypatch.setattr(N, "BLOCK", 32)
    sent, real = [], N.asked

    def counted(*args):
        sent.append(real(*args).agg(F.sum(F.size("ids"))).first()[0])
        return real(*args)

    monkeypatch.setattr(N, "asked", counted)
    for n in (2000, 8000):
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(n).normal(size=(n, 2)))]
        assert len(run(spark, rows, 5)) == n
    assert 0 < sent[1] <= min(5 * sent[0], 4 * 8000)
