"""DuckDB SQL for the subscription tables (the oracle side of sources.tables).

Each oracle query starts with ``WITH`` + ``cte(...)``; the CTE names match the
Spark adapter's tables so oracle queries read like the Spark plans they check.
"""

from __future__ import annotations

REF = "DATE '2001-08-02'"

_BASE = {
    "ord": """ord AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS odate
  FROM orders)""",
    "accounts": """cust_span AS (
  SELECT o_custkey, min(odate) AS first_date, max(odate) AS last_date FROM ord GROUP BY o_custkey),
accounts AS (
  SELECT c.c_custkey AS account_id, c.c_name AS account_name, c.c_mktsegment AS industry,
         r.r_name AS country,
         coalesce(s.first_date, DATE '1995-01-01') AS signup_date,
         CASE c.c_custkey % 5 WHEN 0 THEN 'ads' WHEN 1 THEN 'event' WHEN 2 THEN 'organic'
              WHEN 3 THEN 'other' WHEN 4 THEN 'partner' END AS referral_source,
         CASE c.c_nationkey % 3 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Pro' WHEN 2 THEN 'Enterprise' END AS plan_tier,
         CAST(1 + (c.c_custkey * 7) % 50 AS BIGINT) AS seats,
         c.c_custkey % 7 = 0 AS is_trial,
         coalesce(date_diff('day', s.last_date, {REF}) > 365, false) AS churn_flag
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN cust_span s ON s.o_custkey = c.c_custkey)""".replace("{REF}", REF),
    "subscriptions": """subscriptions AS (
  SELECT o_orderkey AS subscription_id, o_custkey AS account_id, odate AS start_date,
         price AS mrr_amount,
         CASE WHEN o_orderstatus = 'F' THEN 'annual' ELSE 'monthly' END AS billing_frequency,
         o_orderpriority = '1-URGENT' AS upgrade_flag,
         o_orderpriority = '5-LOW' AS downgrade_flag,
         o_orderstatus = 'P' AS churn_flag
  FROM ord)""",
    "usage": """usage AS (
  SELECT l_orderkey * 10 + l_linenumber AS usage_id, l_orderkey AS subscription_id,
         'feature_' || CAST(l_partkey % 40 AS VARCHAR) AS feature_name,
         CAST(l_quantity AS BIGINT) AS usage_count,
         CAST(l_quantity AS BIGINT) * 60 AS usage_duration_secs,
         CAST(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS BIGINT) AS error_count,
         l_linestatus = 'O' AS is_beta_feature
  FROM lineitem)""",
    "tickets": """tickets AS (
  SELECT event_id AS ticket_id, user_id AS account_id,
         CAST(floor(value) AS BIGINT) % 6 AS satisfaction_score,
         CAST(value AS DECIMAL(18,2)) AS first_response_time_minutes,
         CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE) AS resolution_time_hours,
         CASE event_type WHEN 'error' THEN 'Urgent' WHEN 'purchase' THEN 'High'
              WHEN 'click' THEN 'Medium' ELSE 'Low' END AS priority,
         CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90 AS escalation_flag
  FROM events)""",
    "churn": """ord_next AS (
  SELECT *, lead(odate) OVER (PARTITION BY o_custkey ORDER BY odate, o_orderkey) AS next_date FROM ord),
churn_events AS (
  SELECT o_orderkey AS churn_event_id, o_custkey AS account_id, o_orderpriority AS reason_code,
         price AS refund_amount_usd, next_date IS NOT NULL AS is_reactivation,
         CAST(odate + INTERVAL 365 DAY AS DATE) AS churn_date
  FROM ord_next
  WHERE (next_date IS NULL AND date_diff('day', odate, {REF}) > 365)
     OR date_diff('day', odate, next_date) > 900)""".replace("{REF}", REF),
}

# dependency order of the base CTEs
_NEEDS = {
    "accounts": ["ord"],
    "subscriptions": ["ord"],
    "churn": ["ord"],
    "usage": [],
    "tickets": [],
    "ord": [],
}
_ORDER = ["ord", "accounts", "subscriptions", "usage", "tickets", "churn"]


def cte(*tables: str) -> str:
    """Comma-joined CTE text for the named subscription tables (with deps)."""
    want: set[str] = set()
    stack = list(tables)
    while stack:
        t = stack.pop()
        if t not in want:
            want.add(t)
            stack.extend(_NEEDS[t])
    return ",\n".join(_BASE[t] for t in _ORDER if t in want)
