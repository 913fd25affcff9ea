"""DuckDB oracle SQL for the registered queries (same column names as Spark).

Written independently of the Spark operators: plain SQL over the driver's
tables, with the adapter views as CTEs.  Doubles are rounded to 6 digits.
"""

from __future__ import annotations

from .oracle_views import with_views

CALL_NUMERIC = [f"{s}_{c}" for s in ("agent", "customer")
                for c in ("loudness_mean", "negative_sentence", "neutral_sentence", "positive_sentence",
                          "sentiment_score", "talktime", "total_sentence")] + \
               ["total_conversation_duration", "total_talktime", "days_call_to_contract"]
CALL_DOUBLE = [c for c in CALL_NUMERIC if c.endswith(("loudness_mean", "sentiment_score", "talktime"))] + \
              ["total_conversation_duration"]
FE_A = {
    "agent_customer_talktime_ratio": "agent_talktime / (customer_talktime + 1)",
    "sentiment_difference": "agent_sentiment_score - customer_sentiment_score",
    "avg_sentiment": "(agent_sentiment_score + customer_sentiment_score) / 2",
    "total_sentences": "agent_total_sentence + customer_total_sentence",
    "agent_sentence_ratio": "agent_total_sentence / (agent_total_sentence + customer_total_sentence + 1)",
    "silence_ratio": "1 - total_talktime / (total_conversation_duration + 1)",
    "agent_positivity_ratio": "agent_positive_sentence / (agent_positive_sentence + agent_negative_sentence + 1)",
    "customer_positivity_ratio":
        "customer_positive_sentence / (customer_positive_sentence + customer_negative_sentence + 1)",
}


def _r(c: str) -> str:
    return f"{r6(c)} AS {c}"


def r6(c: str) -> str:
    """Same rounding as the Spark side: 1e-12 relative nudge, then 6 digits."""
    return f"round(({c}) * (1 + 1e-12), 6) + 0.0"


def _cleaned_calls() -> str:
    """Median fill of every numeric call column (all hold nulls in the fixtures)."""
    filled = [f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM calls)) AS {c}" for c in CALL_NUMERIC]
    return ("cleaned AS (SELECT record_no, unpaid_flag, contract_date, " + ", ".join(filled)
            + ", total_talktime_text FROM calls)")


def _customer_features_cte() -> str:
    fe = ", ".join(f"{expr} AS {name}" for name, expr in FE_A.items())
    feats = f"featured AS (SELECT *, {fe} FROM cleaned)"
    cols = CALL_NUMERIC + list(FE_A)
    aggs = []
    for c in cols:
        if "sentence" in c or "count" in c:
            aggs.append(f"coalesce(sum({c}), 0) AS {c}")
        else:
            aggs.append(f"avg({c}) AS {c}")
    cust = ("customers AS (SELECT record_no, " + ", ".join(aggs)
            + ", CAST(count(*) AS BIGINT) AS call_count FROM featured f WHERE record_no IS NOT NULL GROUP BY record_no)")
    mode = ("modes AS (SELECT k AS record_no, unpaid_flag FROM (SELECT k, unpaid_flag, row_number() OVER "
            "(PARTITION BY k ORDER BY n DESC, unpaid_flag) AS rn FROM (SELECT record_no AS k, unpaid_flag, "
            "count(*) AS n FROM featured GROUP BY 1, 2)) WHERE rn = 1)")
    return ",\n".join([_cleaned_calls(), feats, cust, mode])


def _customer_features_sql() -> str:
    cols = CALL_NUMERIC + list(FE_A)
    sel = ", ".join(_r(f"c.{c}").replace(f"AS c.{c}", f"AS {c}") for c in cols)
    return (with_views("calls") + ",\n" + _customer_features_cte()
            + f"\nSELECT c.record_no, {sel}, m.unpaid_flag, c.call_count "
            "FROM customers c JOIN modes m ON c.record_no = m.record_no")


def _call_records_sql() -> str:
    cols = []
    for c in ["record_no", "unpaid_flag", "contract_date", "start_ts", "contact_id", "agent"] + \
            [f"{s}_{x}" for s in ("agent", "customer") for x in
             ("loudness_mean", "negative_sentence", "neutral_sentence", "positive_sentence",
              "sentiment_score", "talktime", "total_sentence")] + \
            ["total_conversation_duration", "total_talktime", "days_call_to_contract", "total_talktime_text"]:
        cols.append(_r(c) if c in CALL_DOUBLE else c)
    return with_views("calls") + "\nSELECT " + ", ".join(cols) + " FROM calls"


_SCORE = ("greatest(CAST(0.0 AS DOUBLE), least(CAST(100.0 AS DOUBLE), CAST(50.0 AS DOUBLE)"
          " + CASE WHEN coalesce({s}, 0) < -0.5 THEN 20.0 WHEN coalesce({s}, 0) < 0 THEN 10.0 ELSE 0.0 END"
          " + CASE WHEN coalesce({b}, 0) < 5000 THEN 15.0 WHEN coalesce({b}, 0) > 30000 THEN -10.0 ELSE 0.0 END"
          " + coalesce(len({f}), 0) * 5.0))")
_RT_BAND = "CASE WHEN {x} >= 70 THEN '高リスク' WHEN {x} >= 40 THEN '中リスク' ELSE '低リスク' END"


def _scored_customers_cte() -> str:
    score = _SCORE.format(s="round(c.customer_sentiment_score, 9)", b="k.account_balance", f="k.risk_factors")
    return (with_views("calls", "crm") + ",\n" + _customer_features_cte()
            + ",\nscored AS (SELECT c.record_no, c.call_count, c.customer_sentiment_score, k.account_balance,"
            " CAST(coalesce(len(k.risk_factors), 0) AS INTEGER) AS n_risk_factors,"
            f" {score} AS risk_score FROM customers c LEFT JOIN crm k ON c.record_no = k.customer_id)")


ORACLE = {
    "call_records": _call_records_sql(),
    "crm_customers": with_views("crm") + """
SELECT customer_id, name, round(account_balance * (1 + 1e-12), 6) + 0.0 AS account_balance,
       payment_count,
       array_to_string(risk_factors, ',') AS risk_factors, previous_calls,
       round(satisfaction_score * (1 + 1e-12), 6) + 0.0 AS satisfaction_score, segment FROM crm""",
    "customer_features": _customer_features_sql(),
    "top_risk_customers": _scored_customers_cte() + f"""
SELECT record_no, call_count, {r6('customer_sentiment_score')} AS customer_sentiment_score,
       round(account_balance * (1 + 1e-12), 6) + 0.0 AS account_balance, n_risk_factors, round(risk_score, 6) AS risk_score,
       {_RT_BAND.format(x='risk_score')} AS risk_category
FROM scored ORDER BY risk_score DESC, record_no LIMIT 10""",
}
