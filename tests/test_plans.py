"""Physical-plan properties: projections and filters reach the parquet scans,
no row-at-a-time Python in the SQL paths."""

import contextlib
import io
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E  # noqa: E402
from conftest import SF_SMALL  # noqa: E402


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_call_adapter_prunes_lineitem_columns(spark):
    p = plan(E.queries()["call_records"](spark, SF_SMALL))
    assert ("ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_discount:double,l_tax:double,"
            "l_returnflag:string,l_linestatus:string,l_shipdate:timestamp_ntz>") in p
    assert "l_comment" not in p and "l_extendedprice" not in p


def test_category_filter_reaches_scan_and_drops_unused_join(spark):
    p = plan(E.queries()["category_filter"](spark, SF_SMALL))
    assert "EqualTo(o_orderpriority,1-URGENT)" in p
    assert "lineitem" not in p                     # the unused line aggregate is pruned away


@pytest.mark.parametrize("name", ["top_risk_customers", "live_results", "call_sessions", "rule_reasons",
                                  "mobile_recommendations", "crm_flatten"])
def test_no_python_udfs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()                                   # final adaptive plan, with code-generation stages
    p = plan(df)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "WholeStageCodegen" in p or "codegen id" in p


def test_scored_customers_read_lineitem_once_and_only_what_they_need(spark):
    p = plan(E.queries()["top_risk_customers"](spark, SF_SMALL))
    assert "ExistingRDD" not in p
    schemas = [line for line in p.splitlines() if "ReadSchema" in line and "l_orderkey" in line]
    assert len(schemas) == 1 and "l_quantity" not in schemas[0] and "l_shipdate" not in schemas[0]


def test_last_segments_are_limited_before_the_shuffle(spark):
    p = plan(E.queries()["segment_buffer"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p
