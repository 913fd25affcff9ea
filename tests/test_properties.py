"""Property tests: distributed exact statistics equal brute force on random
small fixtures (several groups per Spark job to keep the runs short)."""

import numpy as np
import pytest
from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callrisk.functions import bands as B
from callrisk.functions.ranking import auc_from_scores, exact_quantiles

SETTINGS = dict(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.one_of(st.none(), st.integers(-20, 20).map(float), st.floats(-5, 5, allow_nan=False)),
                  min_size=1, max_size=40)


@settings(**SETTINGS)
@given(st.lists(values, min_size=1, max_size=4))
def test_quantiles_equal_numpy(spark, groups):
    rows = [(g, v) for g, vs in enumerate(groups) for v in vs]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r["g"]: r for r in exact_quantiles(df, ["x"], {"q1": 0.25, "q2": 0.5, "q3": 0.75}, by=("g",),
                                              partitions=5).collect()}
    for g, vs in enumerate(groups):
        xs = [v for v in vs if v is not None]
        if not xs:
            assert g not in got
            continue
        for name, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
            assert got[g][name] == pytest.approx(float(np.percentile(xs, p * 100)), abs=1e-9)
        assert got[g]["n"] == len(xs)


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6).map(lambda v: v / 6)), min_size=2, max_size=60))
def test_auc_equals_pair_count(spark, rows):
    df = spark.createDataFrame(rows, "label int, p double")
    got = auc_from_scores(df, "label", "p", partitions=4).first()["auc"]
    pos = [p for lab, p in rows if lab == 1]
    neg = [p for lab, p in rows if lab == 0]
    if not pos or not neg:
        assert got is None
        return
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    assert got == pytest.approx(wins / (len(pos) * len(neg)))


def _py_band(x, spec):
    if x is None:
        return None
    for cut, lab in zip(spec.cuts, spec.labels):
        if (x > cut) if spec.strict else (x >= cut):
            return lab
    return spec.labels[-1]


@settings(**SETTINGS)
@given(st.lists(st.one_of(st.none(), st.floats(-10, 110, allow_nan=False),
                          st.sampled_from([35.0, 40.0, 60.0, 70.0])), min_size=1, max_size=50))
def test_bands_match_cut_tables(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    specs = list(B.SPECS.values())
    out = df.select("i", *[B.band("x", s).alias(s.name) for s in specs]).orderBy("i").collect()
    for r, x in zip(out, xs):
        for s in specs:
            assert r[s.name] == _py_band(x, s)
