"""Exact quantiles by bracketing, against numpy, with passes counted and plans checked."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callrisk.functions import selection as SL
from callrisk.operators import clean as C
from callrisk.operators import profile as P

PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


def check(spark, columns, probs=PROBS):
    names = list(columns)
    n = max(map(len, columns.values()))
    rows = [tuple(float(v[i]) if i < len(v) and v[i] is not None else None for v in columns.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(7)
    found, _ = SL.quantiles(df, names, probs)
    for c in names:
        kept = [x for x in columns[c] if x is not None]
        if not kept:
            assert c not in found
            continue
        assert found[c]["n"] == len(kept)
        for alias, p in probs.items():
            assert found[c][alias] == pytest.approx(np.quantile(kept, p), rel=1e-12, abs=1e-12), (c, alias)


@pytest.fixture(params=["as set", "crude sketch", "nothing collected"])
def setting(request, monkeypatch):
    """Results must not depend on how good the sketch is or how much may be collected."""
    if request.param != "as set":
        monkeypatch.setattr(SL, "ACCURACY", 20)
        monkeypatch.setattr(SL, "COLLECT", 40 if request.param == "crude sketch" else 1)


def test_quantiles_of_many_shapes(spark, setting):
    rng = np.random.default_rng(1)
    ties = [7.0] * 400 + list(rng.normal(size=300))
    check(spark, {"normal": list(rng.normal(size=700)), "ties": ties, "one": [3.0], "none": [None] * 5, "two": [1.0, 2.0],
                  "spread": list(10.0 ** rng.uniform(-300, 300, 500)) + list(-10.0 ** rng.uniform(-300, 300, 199)),
                  "integers": list(rng.integers(-5, 5, 650)), "holes": [None if i % 3 else i * 0.1 for i in range(700)]})


def test_few_passes_over_many_rows(spark, monkeypatch):
    df = spark.range(200_000).select((F.hash("id") / 1e6).alias("x"), (F.col("id") % 10).cast("double").alias("y"),
                                     (F.col("id") * F.col("id")).cast("double").alias("z"))
    passes = []
    kind = type(df)
    real = kind.agg
    monkeypatch.setattr(kind, "agg", lambda self, *a: passes.append(1) or real(self, *a))
    found, more = SL.quantiles(df, ["x", "y", "z"], {"m": 0.5}, [F.max("z").alias("top")])
    assert len(passes) == 2 and more == {"top": 199_999.0 ** 2}
    for c in ("x", "y", "z"):
        assert found[c]["m"] == pytest.approx(df.select(F.median(c)).first()[0], rel=1e-12)


def test_plans_hold_no_shuffled_values(spark):
    """Medians and quartiles come from aggregates: the filled table is a plain projection of its scan."""
    df = spark.range(1000).select(F.col("id").alias("record_no"), F.when(F.col("id") % 4 > 0, F.col("id") * 1.5).alias("v"))
    filled = C.median_fill(df)
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Exchange" not in plan
    assert filled.where("v IS NULL").count() == 0
    d = {r["column"]: r for r in P.describe(df).collect()}
    assert d["v"]["count"] == 750 and d["v"]["q50"] == pytest.approx(df.select(F.median("v")).first()[0])
    assert C.median_fill(df.limit(0)).count() == 0 and P.describe(df.limit(0)).count() == 0
