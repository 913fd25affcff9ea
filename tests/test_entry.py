"""Driver contract: entry() runs, every query has a callable, oracles exist for
SQL-checkable queries, and a sample of queries equals its oracle on sf0.001."""

import pytest

import sys, os
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E
from conftest import SF_SMALL


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["record_no", "call_count", "customer_sentiment_score", "account_balance",
                          "n_risk_factors", "risk_score", "risk_category"]


def test_registry_shape():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 90


def test_entry_works_without_the_text_operators(tmp_path):
    """The subpackage, its pipeline and its tests can be deleted; everything else stays registered."""
    import shutil
    import subprocess
    root = os.path.dirname(os.path.abspath(E.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "*.pyc", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=copy,
                          capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)
    assert said.returncode == 0, said.stderr
    assert set(said.stdout.split()) == set(E.queries()) - set(E.LLM_QUERIES)


def test_entry_works_without_a_library_of_the_text_operators():
    import subprocess
    root = os.path.dirname(os.path.abspath(E.__file__))
    said = subprocess.run([sys.executable, "-B", "-c", "import sys; sys.modules['public_tokenizers'] = None\n"
                           "import __spark_entry__ as e; print(*e.queries())"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert set(said.stdout.split()) == set(E.queries()) - set(E.LLM_QUERIES)


@pytest.mark.parametrize("name", ["customer_features", "call_history", "call_sessions", "rule_auc",
                                  "describe_calls", "segment_buffer", "crm_upsert", "rule_reasons"])
def test_query_equals_oracle(spark, name):
    from oracle_check import compare
    res = compare(spark, SF_SMALL, [name], verbose=False)
    assert res[name][0] == "ok", res[name]
