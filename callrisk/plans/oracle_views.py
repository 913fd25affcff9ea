"""DuckDB twins of the adapter views (FIXTURES.md §B), as CTE text.

Used only to build the independent SQL oracles in ``oracle.py``; nothing in
the Spark engine reads these strings.
"""

from __future__ import annotations

_SIDES = (("agent", "O"), ("customer", "F"))
_TONES = (("negative", "R"), ("neutral", "A"), ("positive", "N"))


def _calls_sql() -> str:
    per_order = []
    for side, st in _SIDES:
        per_order.append(f"avg(CASE WHEN l_linestatus = '{st}' THEN l_discount END) * 100.0 "
                         f"AS {side}_loudness_mean")
        for tone, fl in _TONES:
            per_order.append(f"CAST(count_if(l_linestatus = '{st}' AND l_returnflag = '{fl}') AS BIGINT) "
                             f"AS {side}_{tone}_sentence")
        per_order.append(f"CAST(count_if(l_linestatus = '{st}') AS BIGINT) AS {side}_total_sentence")
        per_order.append(f"sum(CASE WHEN l_linestatus = '{st}' THEN l_quantity END) AS {side}_talktime")
    per_order += ["sum(l_quantity) AS total_talktime",
                  "round(sum(l_quantity * (1 + 5 * l_tax)), 4) AS total_conversation_duration",
                  "min(l_shipdate) AS contract_date"]
    outer = ["o_custkey AS record_no",
             "CASE WHEN o_orderstatus = 'P' THEN '未払' ELSE '支払済' END AS unpaid_flag",
             "CAST(contract_date AS TIMESTAMP) AS contract_date",
             "CAST(o_orderdate AS TIMESTAMP) AS start_ts",
             "o_orderkey AS contact_id", "o_orderpriority AS agent"]
    for side, _ in _SIDES:
        outer.append(f"{side}_loudness_mean")
        for tone, _ in _TONES:
            outer.append(f"{side}_{tone}_sentence")
        outer.append(f"({side}_positive_sentence - {side}_negative_sentence) / "
                     f"nullif({side}_total_sentence, 0) AS {side}_sentiment_score")
        outer.append(f"{side}_talktime")
        outer.append(f"{side}_total_sentence")
    outer += ["total_conversation_duration", "total_talktime",
              "CAST(CAST(contract_date AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS days_call_to_contract",
              "CASE WHEN total_talktime IS NULL THEN 'n/a' "
              "ELSE CAST(CAST(total_talktime AS BIGINT) AS VARCHAR) END AS total_talktime_text"]
    return ("calls AS (SELECT " + ", ".join(outer) + " FROM orders LEFT JOIN (SELECT l_orderkey, "
            + ", ".join(per_order) + " FROM lineitem GROUP BY l_orderkey) li ON o_orderkey = li.l_orderkey)")


CALLS = _calls_sql()

CRM = """crm AS (
  SELECT c_custkey AS customer_id, c_name AS name, c_acctbal * 5.0 AS account_balance,
         coalesce(oc.n_orders, 0) AS payment_count,
         list_filter([CASE WHEN c_acctbal * 5.0 > 30000 THEN 'high_balance' END,
                      CASE WHEN coalesce(oc.n_pending, 0) >= 4 THEN 'irregular_payments' END,
                      CASE WHEN c_acctbal * 5.0 < 0 THEN 'negative_balance' END,
                      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'watch_segment' END,
                      CASE WHEN coalesce(oc.n_orders, 0) >= 12 THEN 'heavy_caller' END], lambda x: x IS NOT NULL)
           AS risk_factors,
         coalesce(oc.n_orders, 0) AS previous_calls,
         CAST(3.0 AS DOUBLE) + CAST(c_custkey % 20 AS DOUBLE) / 10.0 AS satisfaction_score,
         c_mktsegment AS segment
  FROM customer
  LEFT JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders,
                    CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS n_pending
             FROM orders GROUP BY o_custkey) oc ON c_custkey = oc.o_custkey)"""

SNAPSHOTS = """snapshots AS (
  SELECT event_id, user_id AS call_id,
         make_timestamp(CAST(us - us % 86400000000 + 41400000000 + (us % 86400000000) // 5000 AS BIGINT)) AS ts,
         CASE event_type WHEN 'signup' THEN 'START' WHEN 'error' THEN 'END' ELSE 'SEGMENT' END AS kind,
         CASE WHEN event_type = 'purchase' THEN 'CUSTOMER'
              WHEN event_type IN ('click', 'view') THEN 'AGENT' END AS speaker,
         'agent-' || CAST(user_id % 12 AS VARCHAR) AS agent_id,
         CAST(NULL AS DOUBLE) AS agent_sentiment,
         least(value, CAST(100.0 AS DOUBLE)) / 50.0 - 1.0 AS customer_sentiment,
         CAST(NULL AS DOUBLE) AS confidence, props
  FROM (SELECT * EXCLUDE (ts), epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events))"""

SEGMENTS = """segments AS (
  SELECT conv_id // 4 AS contact_id, (conv_id % 4) * 1000 + turn AS segment_id,
         CASE WHEN role = 'user' THEN 'CUSTOMER' ELSE 'AGENT' END AS speaker, text,
         CAST((length(text) % 101) / 100.0 AS DOUBLE) AS positive_score,
         CAST(((length(text) * 7) % 101) / 100.0 AS DOUBLE) AS negative_score,
         1704067200 + (conv_id // 4) * 36000 + ((conv_id % 4) * 1000 + turn) * 5 AS epoch_s
  FROM conversations WHERE role IN ('user', 'assistant'))"""

PROFILE = """profile AS (
  SELECT o_custkey AS record_no, o_orderkey AS contact_id, CAST(o_orderdate AS TIMESTAMP) AS start_ts,
         o_orderpriority AS agent,
         CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(1000 + o_orderkey % 9000 AS DOUBLE) END AS annual_income,
         CAST(18 + o_orderkey % 90 AS DOUBLE) AS age, o_totalprice AS loan_amount,
         CAST(100 + o_orderkey % 700 AS DOUBLE) AS monthly_income,
         CAST(300 + o_orderkey % 650 AS DOUBLE) AS credit_score,
         CAST(o_orderstatus = 'P' AS INTEGER) AS unpaid_flag
  FROM orders)"""

VIEWS = {"calls": CALLS, "crm": CRM, "snapshots": SNAPSHOTS, "segments": SEGMENTS, "profile": PROFILE}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(VIEWS[n] for n in names)
