"""Registered queries on skewed copies of the driver tables: one customer owns a
third of all orders (calls) and one live call owns a third of all events.
Results must still equal the DuckDB oracles (the hot keys span several range
partitions in the rank / running-count jobs)."""

import os

import duckdb
import pytest

from conftest import SF_SMALL
from oracle_check import TABLES, compare


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    for t in TABLES:
        src = os.path.join(SF_SMALL, f"{t}.parquet")
        dst = os.path.join(d, f"{t}.parquet")
        if t == "orders":
            con.execute(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey)"
                        f" FROM read_parquet('{src}')) TO '{dst}' (FORMAT PARQUET)")
        elif t == "events":
            con.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id)"
                        f" FROM read_parquet('{src}')) TO '{dst}' (FORMAT PARQUET)")
        else:
            os.symlink(src, dst)
    hot = con.execute(f"SELECT max(n) * 1.0 / sum(n) FROM (SELECT count(*) n FROM read_parquet('{d}/orders.parquet')"
                      f" GROUP BY o_custkey)").fetchone()[0]
    assert hot > 0.3
    return d


@pytest.mark.parametrize("name", ["call_history", "customer_features", "crm_customers", "top_risk_customers",
                                  "session_events", "call_sessions", "debounced_events", "periodic_rescoring",
                                  "median_filled_calls", "customer_first_flag", "live_gauges"])
def test_hot_key_queries_equal_oracle(spark, skewed_dir, name):
    res = compare(spark, skewed_dir, [name], verbose=False)
    assert res[name][0] == "ok", res[name]
