"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark plans (plain SQL with window functions and
CTEs) over the same driver tables; column names and types match the Spark
output (BIGINT for integers, DOUBLE for measures, DATE, VARCHAR, BOOLEAN).
"""

from __future__ import annotations

from .oracle_base import REF, cte

ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# ----------------------------------------------------------------- sources
register("table_row_counts", f"""
WITH {cte('accounts', 'subscriptions', 'usage', 'tickets', 'churn')}
SELECT 'accounts' AS table_name, count(*) AS row_count FROM accounts
UNION ALL SELECT 'subscriptions', count(*) FROM subscriptions
UNION ALL SELECT 'feature_usage', count(*) FROM usage
UNION ALL SELECT 'support_tickets', count(*) FROM tickets
UNION ALL SELECT 'churn_events', count(*) FROM churn_events
""")

# ----------------------------------------------------------------- features
SUBS_AGG = """subs_agg AS (
  SELECT account_id,
         CAST(sum(mrr_amount) AS DOUBLE) AS total_mrr,
         CAST(sum(mrr_amount) AS DOUBLE) / count(mrr_amount) AS avg_sub_mrr,
         CAST(max(mrr_amount) AS DOUBLE) AS max_sub_mrr,
         count(subscription_id) AS total_subscriptions_count,
         CAST(count_if(upgrade_flag) AS BIGINT) AS upgrade_count,
         CAST(count_if(downgrade_flag) AS BIGINT) AS downgrade_count,
         CAST(count_if(billing_frequency = 'annual') AS BIGINT) AS annual_billing_count,
         CAST(count_if(billing_frequency = 'monthly') AS BIGINT) AS monthly_billing_count,
         min(start_date) AS first_sub_date, max(start_date) AS last_sub_date,
         CAST(count_if(upgrade_flag) - count_if(downgrade_flag) AS BIGINT) AS net_expansion_score,
         CAST(count_if(billing_frequency = 'annual') AS DOUBLE) / count(subscription_id) AS annual_billing_ratio
  FROM subscriptions GROUP BY account_id)"""

USAGE_AGG = """usage_acc AS (
  SELECT u.*, s.account_id FROM usage u LEFT JOIN subscriptions s ON u.subscription_id = s.subscription_id),
usage_agg0 AS (
  SELECT account_id,
         count(usage_id) AS total_feature_events,
         CAST(sum(usage_duration_secs) AS DOUBLE) / 3600.0 AS total_duration_hours,
         CAST(sum(usage_duration_secs) AS DOUBLE) / count(usage_duration_secs) / 60.0 AS avg_session_duration_mins,
         CAST(sum(error_count) AS BIGINT) AS total_errors,
         count(DISTINCT feature_name) AS distinct_features_used,
         CAST(count_if(is_beta_feature) AS BIGINT) AS beta_feature_events
  FROM usage_acc WHERE account_id IS NOT NULL GROUP BY account_id),
usage_agg AS (
  SELECT *,
         CAST(total_errors AS DOUBLE) / greatest(total_feature_events, 1) * 100.0 AS error_rate_per_100_events,
         CAST(beta_feature_events AS DOUBLE) / greatest(total_feature_events, 1) AS beta_feature_usage_ratio
  FROM usage_agg0)"""

TICKET_AGG = """ticket_agg0 AS (
  SELECT account_id,
         count(ticket_id) AS total_tickets,
         CAST(sum(satisfaction_score) FILTER (WHERE satisfaction_score > 0) AS DOUBLE)
           / count(satisfaction_score) FILTER (WHERE satisfaction_score > 0) AS avg_csat,
         CAST(min(satisfaction_score) FILTER (WHERE satisfaction_score > 0) AS BIGINT) AS min_csat,
         CAST(sum(first_response_time_minutes) AS DOUBLE) / count(first_response_time_minutes) AS avg_first_response_min,
         sum(resolution_time_hours) / count(resolution_time_hours) AS avg_resolution_hours,
         CAST(count_if(escalation_flag) AS BIGINT) AS total_escalations,
         CAST(count_if(priority = 'Urgent') AS BIGINT) AS urgent_tickets,
         CAST(count_if(priority = 'High') AS BIGINT) AS high_tickets
  FROM tickets WHERE account_id IS NOT NULL GROUP BY account_id),
ticket_agg AS (
  SELECT *,
         CAST(total_escalations AS DOUBLE) / greatest(total_tickets, 1) * 100.0 AS escalation_rate_pct,
         CAST(urgent_tickets + high_tickets AS DOUBLE) / greatest(total_tickets, 1) AS urgent_ticket_ratio
  FROM ticket_agg0)"""

CHURN_AGG = """churn_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY reason_code IS NULL, churn_date, churn_event_id) AS rn
  FROM churn_events),
churn_agg AS (
  SELECT account_id,
         max(reason_code) FILTER (WHERE rn = 1) AS churn_reason,
         CAST(sum(refund_amount_usd) AS DOUBLE) AS refund_amount_usd,
         coalesce(bool_or(is_reactivation), false) AS is_reactivation,
         min(churn_date) AS churn_date
  FROM churn_ranked GROUP BY account_id)"""

C360 = f"""{SUBS_AGG},
{USAGE_AGG},
{TICKET_AGG},
{CHURN_AGG},
gstats AS (
  SELECT CAST(sum(satisfaction_score) FILTER (WHERE satisfaction_score > 0) AS DOUBLE)
           / count(satisfaction_score) FILTER (WHERE satisfaction_score > 0) AS g_csat,
         CAST(sum(first_response_time_minutes) AS DOUBLE) / count(first_response_time_minutes) AS g_resp,
         sum(resolution_time_hours) / count(resolution_time_hours) AS g_resol
  FROM tickets),
c360 AS (
  SELECT a.account_id, a.account_name, a.industry, a.country, a.signup_date, a.referral_source,
         a.plan_tier, a.seats, CAST(a.is_trial AS BIGINT) AS is_trial,
         CAST(a.churn_flag AS BIGINT) AS churn_flag,
         coalesce(s.total_mrr, 0.0) AS total_mrr, s.avg_sub_mrr, s.max_sub_mrr,
         coalesce(s.total_subscriptions_count, 0) AS total_subscriptions_count,
         coalesce(s.upgrade_count, 0) AS upgrade_count, coalesce(s.downgrade_count, 0) AS downgrade_count,
         s.annual_billing_count, s.monthly_billing_count, s.first_sub_date, s.last_sub_date,
         coalesce(s.net_expansion_score, 0) AS net_expansion_score,
         coalesce(s.annual_billing_ratio, 0.0) AS annual_billing_ratio,
         coalesce(u.total_feature_events, 0) AS total_feature_events,
         coalesce(u.total_duration_hours, 0.0) AS total_duration_hours,
         coalesce(u.avg_session_duration_mins, 0.0) AS avg_session_duration_mins,
         coalesce(u.total_errors, 0) AS total_errors,
         coalesce(u.distinct_features_used, 0) AS distinct_features_used,
         u.beta_feature_events,
         coalesce(u.error_rate_per_100_events, 0.0) AS error_rate_per_100_events,
         coalesce(u.beta_feature_usage_ratio, 0.0) AS beta_feature_usage_ratio,
         coalesce(t.total_tickets, 0) AS total_tickets,
         coalesce(t.avg_csat, g.g_csat) AS avg_csat, t.min_csat,
         coalesce(t.avg_first_response_min, g.g_resp) AS avg_first_response_min,
         coalesce(t.avg_resolution_hours, g.g_resol) AS avg_resolution_hours,
         coalesce(t.total_escalations, 0) AS total_escalations,
         coalesce(t.urgent_tickets, 0) AS urgent_tickets, t.high_tickets,
         coalesce(t.escalation_rate_pct, 0.0) AS escalation_rate_pct,
         coalesce(t.urgent_ticket_ratio, 0.0) AS urgent_ticket_ratio,
         c.churn_reason, coalesce(c.refund_amount_usd, 0.0) AS refund_amount_usd,
         c.is_reactivation, c.churn_date,
         coalesce(s.total_mrr, 0.0) / greatest(a.seats, 1) AS mrr_per_seat,
         a.signup_date AS signup_dt, c.churn_date AS churn_dt,
         CAST(greatest(date_diff('day', a.signup_date, coalesce(c.churn_date, {REF})), 1) AS BIGINT) AS tenure_days,
         round(greatest(date_diff('day', a.signup_date, coalesce(c.churn_date, {REF})), 1) / 30.4375, 1) AS tenure_months
  FROM accounts a
  LEFT JOIN subs_agg s ON a.account_id = s.account_id
  LEFT JOIN usage_agg u ON a.account_id = u.account_id
  LEFT JOIN ticket_agg t ON a.account_id = t.account_id
  LEFT JOIN churn_agg c ON a.account_id = c.account_id
  CROSS JOIN gstats g)"""

ALL_TABLES = ("accounts", "subscriptions", "usage", "tickets", "churn")


def with_c360(select_sql: str) -> str:
    return f"WITH {cte(*ALL_TABLES)},\n{C360}\n{select_sql}"


register("c360_subscriptions", f"WITH {cte('subscriptions')},\n{SUBS_AGG}\nSELECT * FROM subs_agg")
register("usage_with_account", f"""
WITH {cte('subscriptions', 'usage')}
SELECT u.subscription_id, u.usage_id, u.feature_name, u.usage_count, u.usage_duration_secs,
       u.error_count, u.is_beta_feature, s.account_id
FROM usage u LEFT JOIN subscriptions s ON u.subscription_id = s.subscription_id""")
register("c360_usage", f"WITH {cte('subscriptions', 'usage')},\n{USAGE_AGG}\nSELECT * FROM usage_agg")
register("c360_tickets", f"WITH {cte('tickets')},\n{TICKET_AGG}\nSELECT * FROM ticket_agg")
register("c360_churn", f"WITH {cte('churn')},\n{CHURN_AGG}\nSELECT * FROM churn_agg")
register("c360_master", with_c360("SELECT * FROM c360"))
register("tenure", with_c360(
    "SELECT account_id, signup_date, churn_date, churn_flag, tenure_days, tenure_months FROM c360"))
register("top_accounts_by_mrr", with_c360("""
SELECT account_id, account_name, industry, plan_tier, seats, total_mrr,
       error_rate_per_100_events, avg_csat, churn_flag
FROM c360 ORDER BY total_mrr DESC, account_id LIMIT 10"""))

C360_B = f"""sub_b AS (
  SELECT account_id, CAST(sum(mrr_amount) AS DOUBLE) AS total_mrr,
         count(subscription_id) AS total_subscriptions_count,
         CAST(count_if(upgrade_flag) AS BIGINT) AS upgrade_count,
         CAST(count_if(downgrade_flag) AS BIGINT) AS downgrade_count,
         CAST(count_if(billing_frequency = 'annual') AS BIGINT) AS annual_billing_count,
         min(start_date) AS first_sub_date, max(start_date) AS last_sub_date
  FROM subscriptions GROUP BY account_id),
usage_b AS (
  SELECT s.account_id, count(u.usage_id) AS total_feature_events,
         CAST(sum(u.usage_count) AS BIGINT) AS total_usage_volume,
         CAST(sum(u.usage_duration_secs) AS DOUBLE) / 3600.0 AS total_duration_hours,
         CAST(sum(u.error_count) AS BIGINT) AS total_errors,
         count(DISTINCT u.feature_name) AS distinct_features_used,
         CAST(count_if(u.is_beta_feature) AS BIGINT) AS beta_feature_events
  FROM usage u LEFT JOIN subscriptions s ON u.subscription_id = s.subscription_id
  WHERE s.account_id IS NOT NULL GROUP BY s.account_id),
ticket_b AS (
  SELECT account_id, count(ticket_id) AS total_tickets,
         CAST(sum(satisfaction_score) FILTER (WHERE satisfaction_score > 0) AS DOUBLE)
           / count(satisfaction_score) FILTER (WHERE satisfaction_score > 0) AS avg_csat,
         CAST(sum(first_response_time_minutes) AS DOUBLE) / count(first_response_time_minutes) AS avg_first_response_min,
         sum(resolution_time_hours) / count(resolution_time_hours) AS avg_resolution_hours,
         CAST(count_if(escalation_flag) AS BIGINT) AS total_escalations,
         CAST(count_if(priority = 'Urgent') AS BIGINT) AS urgent_tickets
  FROM tickets WHERE account_id IS NOT NULL GROUP BY account_id),
m_b AS (
  SELECT a.account_id, a.account_name, a.industry, a.country, a.signup_date, a.referral_source,
         a.plan_tier, a.seats, CAST(a.is_trial AS BIGINT) AS is_trial, CAST(a.churn_flag AS BIGINT) AS churn_flag,
         s.total_mrr, s.total_subscriptions_count, s.upgrade_count, s.downgrade_count,
         s.annual_billing_count, s.first_sub_date, s.last_sub_date,
         s.upgrade_count - s.downgrade_count AS net_expansion_score,
         CAST(s.annual_billing_count AS DOUBLE) / s.total_subscriptions_count AS annual_billing_ratio,
         u.total_feature_events, u.total_usage_volume, u.total_duration_hours, u.total_errors,
         u.distinct_features_used, u.beta_feature_events,
         (u.total_duration_hours * 60.0) / CAST(CASE WHEN u.total_feature_events = 0 THEN 1 ELSE u.total_feature_events END AS DOUBLE) AS avg_session_duration_mins,
         CAST(u.total_errors AS DOUBLE) / CAST(CASE WHEN u.total_feature_events = 0 THEN 1 ELSE u.total_feature_events END AS DOUBLE) * 100.0 AS error_rate_per_100_events,
         CAST(u.beta_feature_events AS DOUBLE) / CAST(CASE WHEN u.total_feature_events = 0 THEN 1 ELSE u.total_feature_events END AS DOUBLE) AS beta_feature_usage_ratio,
         t.total_tickets, t.avg_csat, t.avg_first_response_min, t.avg_resolution_hours,
         t.total_escalations, t.urgent_tickets,
         CAST(t.total_escalations AS DOUBLE) / CAST(CASE WHEN t.total_tickets = 0 THEN 1 ELSE t.total_tickets END AS DOUBLE) * 100.0 AS escalation_rate_pct,
         CAST(t.urgent_tickets AS DOUBLE) / CAST(CASE WHEN t.total_tickets = 0 THEN 1 ELSE t.total_tickets END AS DOUBLE) AS urgent_ticket_ratio,
         round(date_diff('day', a.signup_date, {REF}) / 30.4375, 1) AS tenure_months,
         s.total_mrr / CAST(CASE WHEN a.seats = 0 THEN 1 ELSE a.seats END AS DOUBLE) AS mrr_per_seat
  FROM accounts a LEFT JOIN sub_b s ON a.account_id = s.account_id
  LEFT JOIN usage_b u ON a.account_id = u.account_id
  LEFT JOIN ticket_b t ON a.account_id = t.account_id),
fill_b AS (
  SELECT CAST(sum(CAST(avg_csat AS DECIMAL(38,12))) AS DOUBLE) / count(avg_csat) AS f_csat,
         (list_sort(list(avg_first_response_min))[(count(avg_first_response_min) + 1) // 2]
          + list_sort(list(avg_first_response_min))[count(avg_first_response_min) // 2 + 1]) / 2 AS f_resp,
         (list_sort(list(avg_resolution_hours))[(count(avg_resolution_hours) + 1) // 2]
          + list_sort(list(avg_resolution_hours))[count(avg_resolution_hours) // 2 + 1]) / 2 AS f_resol
  FROM m_b)"""

register("c360_variant_b", f"""
WITH {cte('accounts', 'subscriptions', 'usage', 'tickets')},
{C360_B}
SELECT account_id, account_name, industry, country, signup_date, referral_source, plan_tier,
       seats, is_trial, churn_flag,
       coalesce(total_mrr, 0.0) AS total_mrr,
       coalesce(total_subscriptions_count, 0) AS total_subscriptions_count,
       coalesce(upgrade_count, 0) AS upgrade_count, coalesce(downgrade_count, 0) AS downgrade_count,
       coalesce(annual_billing_count, 0) AS annual_billing_count, first_sub_date, last_sub_date,
       coalesce(net_expansion_score, 0) AS net_expansion_score,
       coalesce(annual_billing_ratio, 0.0) AS annual_billing_ratio,
       coalesce(total_feature_events, 0) AS total_feature_events,
       coalesce(total_usage_volume, 0) AS total_usage_volume,
       coalesce(total_duration_hours, 0.0) AS total_duration_hours,
       coalesce(total_errors, 0) AS total_errors,
       coalesce(distinct_features_used, 0) AS distinct_features_used,
       coalesce(beta_feature_events, 0) AS beta_feature_events,
       coalesce(avg_session_duration_mins, 0.0) AS avg_session_duration_mins,
       coalesce(error_rate_per_100_events, 0.0) AS error_rate_per_100_events,
       coalesce(beta_feature_usage_ratio, 0.0) AS beta_feature_usage_ratio,
       coalesce(total_tickets, 0) AS total_tickets,
       coalesce(avg_csat, f.f_csat, 0.0) AS avg_csat,
       coalesce(avg_first_response_min, f.f_resp, 0.0) AS avg_first_response_min,
       coalesce(avg_resolution_hours, f.f_resol, 0.0) AS avg_resolution_hours,
       coalesce(total_escalations, 0) AS total_escalations,
       coalesce(urgent_tickets, 0) AS urgent_tickets,
       coalesce(escalation_rate_pct, 0.0) AS escalation_rate_pct,
       coalesce(urgent_ticket_ratio, 0.0) AS urgent_ticket_ratio,
       coalesce(tenure_months, 0.0) AS tenure_months,
       coalesce(mrr_per_seat, 0.0) AS mrr_per_seat
FROM m_b CROSS JOIN fill_b f""")

# ----------------------------------------------------------------- cohort
COHORT_CELLS = """cells AS (
  SELECT date_trunc('month', a.signup_date) AS signup_month,
         (year(s.start_date) * 12 + month(s.start_date)) - (year(a.signup_date) * 12 + month(a.signup_date)) AS cohort_index,
         count(DISTINCT s.account_id) AS active_accounts
  FROM subscriptions s JOIN accounts a ON s.account_id = a.account_id
  WHERE (year(s.start_date) * 12 + month(s.start_date)) - (year(a.signup_date) * 12 + month(a.signup_date)) >= 0
  GROUP BY 1, 2),
first_idx AS (SELECT min(cohort_index) AS f FROM cells),
base AS (SELECT c.signup_month, c.active_accounts AS base_accounts FROM cells c, first_idx WHERE c.cohort_index = first_idx.f),
long AS (
  SELECT strftime(c.signup_month, '%Y-%m') AS signup_cohort, CAST(c.cohort_index AS BIGINT) AS cohort_index,
         c.active_accounts, b.base_accounts,
         CAST((c.active_accounts * 2000 + b.base_accounts) // (2 * b.base_accounts) AS DOUBLE) / 10.0 AS retention_pct
  FROM cells c LEFT JOIN base b ON c.signup_month = b.signup_month)"""

register("cohort_retention_long", f"""
WITH {cte('accounts', 'subscriptions')},
{COHORT_CELLS}
SELECT * FROM long""")

register("cohort_retention_matrix", f"""
WITH {cte('accounts', 'subscriptions')},
{COHORT_CELLS}
SELECT signup_cohort, {', '.join(f'max(CASE WHEN cohort_index = {k} THEN retention_pct END) AS m{k}' for k in range(80))}
FROM long GROUP BY signup_cohort""")

register("cohort_retention_active", f"""
WITH {cte('accounts', 'subscriptions')},
cells AS (
  SELECT date_trunc('month', a.signup_date) AS signup_month,
         (year(s.start_date) * 12 + month(s.start_date)) - (year(a.signup_date) * 12 + month(a.signup_date)) AS cohort_index,
         count(DISTINCT s.account_id) AS active_accounts
  FROM subscriptions s JOIN accounts a ON s.account_id = a.account_id
  WHERE NOT s.churn_flag
    AND (year(s.start_date) * 12 + month(s.start_date)) - (year(a.signup_date) * 12 + month(a.signup_date)) >= 0
  GROUP BY 1, 2),
sizes AS (SELECT date_trunc('month', signup_date) AS signup_month, count(DISTINCT account_id) AS cohort_size
          FROM accounts GROUP BY 1),
j AS (SELECT c.*, s.cohort_size,
             dense_rank() OVER (ORDER BY c.signup_month) AS cr,
             dense_rank() OVER (ORDER BY c.cohort_index) AS ir
      FROM cells c JOIN sizes s ON c.signup_month = s.signup_month)
SELECT strftime(signup_month, '%Y-%m') AS signup_month, CAST(cohort_index AS BIGINT) AS cohort_index,
       active_accounts, cohort_size,
       CAST(active_accounts AS DOUBLE) / CAST(cohort_size AS DOUBLE) * 100.0 AS retention_pct
FROM j WHERE cr <= 12 AND ir <= 12""")

# ----------------------------------------------------------------- revenue
MONTHLY = """mm AS (SELECT CAST(date_trunc('month', start_date) AS DATE) AS month, sum(mrr_amount) AS added
       FROM subscriptions GROUP BY 1),
monthly AS (
  SELECT month, strftime(month, '%Y-%m') AS month_str, CAST(added AS DOUBLE) AS mrr_added,
         CAST(sum(added) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_mrr,
         CAST(sum(added) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) * 12 AS DOUBLE) AS cumulative_arr,
         CAST(row_number() OVER (ORDER BY month) - 1 AS BIGINT) AS t
  FROM mm),
sums AS (
  SELECT count(*) AS n, sum(CAST(t AS DECIMAL(38,0))) AS st, sum(CAST(t AS DECIMAL(38,0)) * CAST(t AS DECIMAL(38,0))) AS stt,
         sum(CAST(mrr_added AS DECIMAL(38,2))) AS sy,
         sum(CAST(t AS DECIMAL(38,0)) * CAST(mrr_added AS DECIMAL(38,2))) AS sty,
         max(month) AS last_month, arg_max(cumulative_mrr, month) AS last_cumulative_mrr
  FROM monthly),
fit AS (
  SELECT n, CAST(n * sty - st * sy AS DOUBLE) / CAST(n * stt - st * st AS DOUBLE) AS slope,
         CAST(sy * stt - st * sty AS DOUBLE) / CAST(n * stt - st * st AS DOUBLE) AS intercept,
         last_month, last_cumulative_mrr
  FROM sums),
adds AS (
  SELECT k, CAST(round(CAST(greatest(slope * (n + k - 1) + intercept, 100000.0) AS DECIMAL(38,8)), 2) AS DOUBLE) AS added
  FROM fit, range(1, 13) r(k)),
rec AS (
  SELECT 0 AS k, last_cumulative_mrr AS total FROM fit
  UNION ALL
  SELECT r.k + 1, r.total * 0.982 + a.added FROM rec r JOIN adds a ON a.k = r.k + 1 WHERE r.k < 12),
forecast AS (
  SELECT strftime(CAST(f.last_month + to_months(CAST(a.k AS INTEGER)) AS DATE), '%Y-%m') AS forecast_month,
         a.added AS projected_mrr_added,
         CAST(round(CAST(r.total AS DECIMAL(38,8)), 2) AS DOUBLE) AS projected_total_mrr,
         CAST(round(CAST(CAST(round(CAST(r.total AS DECIMAL(38,8)), 2) AS DOUBLE) * 12.0 AS DECIMAL(38,8)), 2) AS DOUBLE) AS projected_total_arr
  FROM adds a JOIN rec r ON r.k = a.k CROSS JOIN fit f)"""

register("monthly_mrr", f"WITH RECURSIVE {cte('subscriptions')},\n{MONTHLY}\nSELECT * FROM monthly")
register("mrr_trend_fit", f"WITH RECURSIVE {cte('subscriptions')},\n{MONTHLY}\nSELECT * FROM fit")
register("revenue_forecast_12m", f"WITH RECURSIVE {cte('subscriptions')},\n{MONTHLY}\nSELECT * FROM forecast")

register("revenue_forecast_compound", with_c360("""
, run0 AS (SELECT CAST(sum(CAST(total_mrr AS DECIMAL(38,2))) AS DOUBLE) AS r FROM c360),
comp AS (
  SELECT 0 AS k, r FROM run0
  UNION ALL
  SELECT k + 1, r + r * 0.058 - r * 0.018 FROM comp WHERE k < 12)
SELECT '2001-M' || lpad(CAST(k AS VARCHAR), 2, '0') AS forecast_month, r AS projected_mrr,
       r * 12.0 AS projected_total_arr
FROM comp WHERE k >= 1""").replace("WITH RECURSIVE", "WITH").replace("WITH ", "WITH RECURSIVE ", 1))

LTV = """ltv AS (
  SELECT account_id, plan_tier, churn_flag, tenure_months, total_mrr,
         total_mrr AS realized_lifetime_value_usd,
         total_mrr * 0.8 / 0.0183 AS expected_ltv_usd
  FROM c360)"""


def _r2(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,8)), 2) AS DOUBLE)"


def _smean(x: str, scale: int) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(38,{scale}))) AS DOUBLE) / CAST(count({x}) AS DOUBLE))"


def _median(x: str) -> str:
    return (f"((list_sort(list({x}))[(count({x}) + 1) // 2] "
            f"+ list_sort(list({x}))[count({x}) // 2 + 1]) / 2)")


register("ltv_account", with_c360(f", {LTV}\nSELECT * FROM ltv"))
register("ltv_by_tier", with_c360(f""", {LTV}
SELECT plan_tier, count(account_id) AS account_count,
       {_r2(_smean('total_mrr', 2))} AS avg_mrr,
       {_r2(_smean('realized_lifetime_value_usd', 2))} AS avg_realized_ltv,
       {_r2(_smean('expected_ltv_usd', 6))} AS avg_expected_ltv,
       {_r2(_median('tenure_months'))} AS median_tenure_months
FROM ltv GROUP BY plan_tier"""))


def _dollars(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', {_r2(x)})"


def _fixed1(x: str, suffix: str = "") -> str:
    return f"format('{{:.1f}}{suffix}', CAST(round(CAST({x} AS DECIMAL(38,8)), 1) AS DOUBLE))"


register("ltv_by_tier_variant_b", f"""
WITH {cte('accounts', 'subscriptions', 'usage', 'tickets')},
{C360_B},
cb AS (SELECT * FROM m_b),
t AS (SELECT plan_tier, count(*) AS accounts, {_smean('coalesce(total_mrr, 0.0)', 2)} AS avg_mrr,
             CAST(sum(churn_flag) AS DOUBLE) / CAST(count(churn_flag) AS DOUBLE) AS churn,
             {_median('tenure_months')} AS med
      FROM cb GROUP BY plan_tier)
SELECT plan_tier, accounts, {_dollars('avg_mrr')} AS avg_mrr, {_fixed1('med')} AS median_tenure_mo,
       {_dollars('avg_mrr * med')} AS realized_ltv, {_fixed1('churn * 100.0', '%')} AS annual_churn_pct,
       {_dollars('CASE WHEN churn > 0 THEN avg_mrr / churn ELSE avg_mrr * 24.0 END')} AS expected_ltv
FROM t""")

register("ltv_headline", f"""
WITH RECURSIVE {cte(*ALL_TABLES)},
{C360},
{LTV},
{MONTHLY}
SELECT CAST(sum(CAST(total_mrr AS DECIMAL(38,2))) AS DOUBLE) AS total_active_mrr,
       CAST(sum(CAST(total_mrr AS DECIMAL(38,2))) * 12 AS DOUBLE) AS total_active_arr,
       {_r2(_smean('realized_lifetime_value_usd', 2))} AS avg_realized_ltv,
       {_r2(_smean('expected_ltv_usd', 6))} AS avg_expected_ltv,
       (SELECT arg_max(projected_total_mrr, forecast_month) FROM forecast) AS projected_12m_exit_mrr,
       (SELECT arg_max(projected_total_arr, forecast_month) FROM forecast) AS projected_12m_exit_arr
FROM ltv""")

_RIDGE_FEATURES = ["seats", "is_trial", "total_feature_events", "total_duration_hours",
                   "total_errors", "distinct_features_used", "total_tickets", "avg_csat",
                   "realized_lifetime_value_usd"]
register("ltv_ridge_moments", with_c360(", " + LTV + "\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, count(*) AS n,
       round({_smean(f'CAST(coalesce({c}, 0) AS DOUBLE)', 6)}, 6) AS mean,
       round(stddev_pop(CAST(coalesce({c}, 0) AS DOUBLE)), 6) AS std_pop FROM ltv_c""" for c in _RIDGE_FEATURES)
    .replace("ltv_c", "(SELECT c360.*, c360.total_mrr AS realized_lifetime_value_usd FROM c360)")))

# ----------------------------------------------------------------- survival
KM_TT = """tt AS (
  SELECT {by} CAST(tenure_months AS DOUBLE) AS t, count(*) AS removed, CAST(sum(churn_flag) AS BIGINT) AS events
  FROM c360 GROUP BY {by} CAST(tenure_months AS DOUBLE)),
rs AS (
  SELECT *, sum(removed) OVER ({part} ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS at_risk FROM tt),
km AS (
  SELECT *, product(1.0 - events / at_risk) OVER ({part} ORDER BY t ROWS UNBOUNDED PRECEDING) AS survival,
         sum(coalesce(CAST(events AS DOUBLE) / nullif(CAST(at_risk * (at_risk - events) AS DOUBLE), 0), 0.0))
           OVER ({part} ORDER BY t ROWS UNBOUNDED PRECEDING) AS greenwood
  FROM rs)"""


def _km(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return KM_TT.replace("{by}", sel).replace("{part}", part)


def _km_select(by: str) -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""SELECT {sel}t, CAST(at_risk AS BIGINT) AS at_risk, events, CAST(removed - events AS BIGINT) AS censored,
       round(survival, 6) AS survival FROM km
UNION ALL
SELECT {sel}0.0 AS t, CAST(max(at_risk) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1.0 FROM km {grp}
HAVING min(t) > 0"""


register("km_overall", with_c360(", " + _km("") + "\n" + _km_select("")))
register("km_by_tier", with_c360(", " + _km("plan_tier") + "\n" + _km_select("plan_tier")))
register("km_confidence", with_c360(", " + _km("plan_tier") + """
SELECT plan_tier, t, CAST(at_risk AS BIGINT) AS at_risk, events, round(survival, 6) AS survival,
       round(greenwood, 6) AS greenwood_var_sum,
       round(CASE WHEN survival >= 1.0 THEN 1.0 WHEN survival <= 0.0 THEN 0.0
             ELSE exp(-exp(ln(-ln(survival)) + 1.959963984540054 * sqrt(greenwood) / ln(survival))) END, 6) AS ci_lower,
       round(CASE WHEN survival >= 1.0 THEN 1.0 WHEN survival <= 0.0 THEN 0.0
             ELSE exp(-exp(ln(-ln(survival)) - 1.959963984540054 * sqrt(greenwood) / ln(survival))) END, 6) AS ci_upper
FROM km"""))

register("logrank_tier", with_c360("""
, tt AS (
  SELECT CAST(tenure_months AS DOUBLE) AS t, count(*) AS removed, sum(churn_flag) AS d,
         count_if(plan_tier = 'Enterprise') AS removed_a,
         sum(CASE WHEN plan_tier = 'Enterprise' THEN churn_flag ELSE 0 END) AS d_a
  FROM c360 WHERE plan_tier IN ('Enterprise', 'Basic') GROUP BY 1),
rs AS (
  SELECT *, sum(removed) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n,
            sum(removed_a) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n_a FROM tt),
terms AS (
  SELECT d_a, d * (n_a / n) AS e_a,
         coalesce(d * (n_a / n) * (1.0 - n_a / n) * (n - d) / nullif(CAST(n - 1 AS DOUBLE), 0), 0.0) AS v
  FROM rs WHERE d > 0),
agg AS (SELECT CAST(sum(d_a) AS DOUBLE) AS observed_a, sum(e_a) AS expected_a, sum(v) AS variance FROM terms)
SELECT 'Enterprise' AS group_a, 'Basic' AS group_b, observed_a, round(expected_a, 6) AS expected_a,
       round(variance, 6) AS variance, round(stat, 6) AS test_statistic, round(p, 4) AS p_value, p < 0.05 AS statistically_significant
FROM (SELECT *, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n:
          CASE WHEN n % 2 = 0 THEN 1.0 ELSE -1.0 END * sqrt(stat / 2) ** (2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) AS p
      FROM (SELECT *, (observed_a - expected_a) ** 2 / variance AS stat FROM agg))"""))

register("survival_naive_by_tier", f"""
WITH {cte('accounts', 'subscriptions', 'usage', 'tickets')},
{C360_B},
tt AS (
  SELECT plan_tier, CAST(coalesce(tenure_months, 0.0) AS DOUBLE) AS t, count(*) AS removed, sum(churn_flag) AS events
  FROM m_b GROUP BY 1, 2),
x AS (
  SELECT plan_tier, t,
         coalesce(sum(events) OVER (PARTITION BY plan_tier ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
         sum(removed) OVER (PARTITION BY plan_tier) AS n
  FROM tt)
SELECT plan_tier, t, CAST(n - k AS DOUBLE) / CAST(n AS DOUBLE) AS survival FROM x""")

register("survival_headline", with_c360(f"""
SELECT count(*) AS total_accounts, CAST(sum(churn_flag) AS BIGINT) AS churned_accounts,
       CAST(((count(*) - sum(churn_flag)) * 20000 + count(*)) // (2 * count(*)) AS DOUBLE) / 100.0 AS retention_rate_pct,
       {_median('tenure_months')} AS median_tenure_months,
       {_r2(_smean('tenure_months', 1))} AS mean_tenure_months
FROM c360"""))

_COX = ["seats", "is_trial", "error_rate_per_100_events", "avg_first_response_min", "avg_csat",
        "annual_billing_ratio", "net_expansion_score"]
register("cox_risk_sets", with_c360(f"""
, d AS (SELECT * FROM c360 WHERE tenure_months IS NOT NULL AND churn_flag IS NOT NULL
        AND {' AND '.join(f'{c} IS NOT NULL' for c in _COX)}),
tt AS (
  SELECT CAST(tenure_months AS DOUBLE) AS t, count(*) AS removed, CAST(sum(churn_flag) AS BIGINT) AS events,
         {', '.join(f'sum(CAST({c} AS DOUBLE)) AS x_{c}' for c in _COX)},
         {', '.join(f'sum(CASE WHEN churn_flag = 1 THEN CAST({c} AS DOUBLE) ELSE 0.0 END) AS d1_{c}' for c in _COX)}
  FROM d GROUP BY 1),
rs AS (
  SELECT *, sum(removed) OVER w AS at_risk,
         {', '.join(f'sum(x_{c}) OVER w AS s1_{c}' for c in _COX)}
  FROM tt WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING))
SELECT t, CAST(at_risk AS BIGINT) AS at_risk, events,
       {', '.join(f'round(s1_{c}, 6) AS s1_{c}' for c in _COX)},
       {', '.join(f'round(d1_{c}, 6) AS d1_{c}' for c in _COX)}
FROM rs WHERE events > 0"""))

# ----------------------------------------------------------------- statistics
register("anova_refund_by_reason", f"""
WITH {cte('churn')},
g AS (SELECT reason_code, count(refund_amount_usd) AS n_g, sum(CAST(refund_amount_usd * 100 AS BIGINT))::HUGEINT AS s_g,
             sum(CAST(refund_amount_usd * 100 AS BIGINT)::HUGEINT * CAST(refund_amount_usd * 100 AS BIGINT))::HUGEINT AS ss_g
      FROM churn_events WHERE reason_code IS NOT NULL AND refund_amount_usd IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n_g)::HUGEINT AS n, sum(s_g)::HUGEINT AS s FROM g),
v AS (SELECT count(*) AS k, max(t.n) AS n,
             sum(CAST(t.n * s_g - n_g * t.s AS DOUBLE) / CAST(t.n AS DOUBLE) * (CAST(t.n * s_g - n_g * t.s AS DOUBLE) / CAST(t.n AS DOUBLE)) / n_g) / 10000 AS ssb,
             sum(CAST(n_g * ss_g - s_g * s_g AS DOUBLE) / n_g) / 10000 AS ssw FROM g, t)
SELECT CAST(k AS BIGINT) AS groups, CAST(n AS BIGINT) AS n, round(ssb, 2) AS ss_between, round(ssw, 2) AS ss_within,
       CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within,
       round(f, 6) AS f_statistic, round(p, 4) AS p_value, p < 0.05 AS statistically_significant
FROM (SELECT *, CASE WHEN k = 5 THEN x ** (0.5 * (n - k)) * (1 + 0.5 * (n - k) * (1 - x)) WHEN k = 3 THEN x ** (0.5 * (n - k)) END AS p
      FROM (SELECT *, (n - k) / ((n - k) + (k - 1) * f) AS x FROM (SELECT *, (ssb / (k - 1.0)) / (ssw / (n - k)) AS f FROM v)))""")

register("refund_stats_by_reason", f"""
WITH {cte('churn')}
SELECT reason_code, count(refund_amount_usd) AS count,
       {_r2('CAST(sum(refund_amount_usd) AS DOUBLE) / CAST(count(refund_amount_usd) AS DOUBLE)')} AS mean,
       {_r2(_median('CAST(refund_amount_usd AS DOUBLE)'))} AS median,
       {_r2('sqrt(greatest(CASE WHEN count(refund_amount_usd) > 1 THEN (CAST(sum(refund_amount_usd * refund_amount_usd) AS DOUBLE) - CAST(sum(refund_amount_usd) AS DOUBLE) * CAST(sum(refund_amount_usd) AS DOUBLE) / CAST(count(refund_amount_usd) AS DOUBLE)) / (CAST(count(refund_amount_usd) AS DOUBLE) - 1.0) END, 0.0))')} AS std,
       {_r2('CAST(sum(refund_amount_usd) AS DOUBLE)')} AS sum
FROM churn_events GROUP BY reason_code""")

register("tier_churn_crosstab", with_c360("""
SELECT plan_tier, CAST(count_if(churn_flag = 0) AS BIGINT) AS churn_flag_0,
       CAST(count_if(churn_flag = 1) AS BIGINT) AS churn_flag_1
FROM c360 GROUP BY plan_tier"""))

register("chisq_tier_churn", with_c360("""
, cells AS (SELECT plan_tier, churn_flag, count(*) AS observed FROM c360
            WHERE plan_tier IS NOT NULL AND churn_flag IS NOT NULL GROUP BY 1, 2),
e AS (SELECT *, CAST(sum(observed) OVER (PARTITION BY plan_tier) * sum(observed) OVER (PARTITION BY churn_flag) AS DOUBLE)
                 / CAST(sum(observed) OVER () AS DOUBLE) AS expected,
             CAST((count(DISTINCT plan_tier) OVER () - 1) * (count(DISTINCT churn_flag) OVER () - 1) AS BIGINT) AS dof
      FROM cells),
c AS (SELECT *, (observed - expected) ** 2 / expected AS contribution FROM e)
SELECT plan_tier, churn_flag, observed, round(expected, 6) AS expected, round(contribution, 6) AS contribution,
       round(stat, 6) AS chi2_statistic, dof, round(exp(-stat / 2), 4) AS p_value, exp(-stat / 2) < 0.05 AS statistically_significant
FROM (SELECT *, sum(contribution) OVER () AS stat FROM c)"""))

_CORR = ["tenure_months", "total_mrr", "seats", "error_rate_per_100_events", "total_duration_hours",
         "avg_session_duration_mins", "total_tickets", "avg_csat", "avg_first_response_min",
         "avg_resolution_hours", "churn_flag"]


def _corr_sql(cols, source):
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, "
                         f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 3) AS r FROM {source}")
    return "\nUNION ALL\n".join(parts)


register("correlation_matrix", with_c360(_corr_sql(_CORR, "c360")))
register("correlation_matrix_variant_b", f"""
WITH {cte('accounts', 'subscriptions', 'usage', 'tickets')},
{C360_B},
cb AS (SELECT total_mrr, seats, coalesce(tenure_months, 0.0) AS tenure_months,
              coalesce(error_rate_per_100_events, 0.0) AS error_rate_per_100_events,
              coalesce(avg_csat, (SELECT f_csat FROM fill_b), 0.0) AS avg_csat,
              coalesce(avg_first_response_min, (SELECT f_resp FROM fill_b), 0.0) AS avg_first_response_min,
              coalesce(total_tickets, 0) AS total_tickets, churn_flag,
              coalesce(total_mrr, 0.0) AS total_mrr0 FROM m_b),
cb2 AS (SELECT * EXCLUDE (total_mrr) RENAME (total_mrr0 AS total_mrr) FROM cb)
{_corr_sql(["total_mrr", "seats", "tenure_months", "error_rate_per_100_events", "avg_csat",
            "avg_first_response_min", "total_tickets", "churn_flag"], "cb2")}""")

_OLS_NAMES = ["const", "first_response_time_minutes", "resolution_time_hours", "is_escalated",
              "is_urgent", "is_high", "satisfaction_score"]
_OLS_EXPR = {"const": "1", "first_response_time_minutes": "first_response_time_minutes",
             "resolution_time_hours": "resolution_time_hours",
             "is_escalated": "CAST(escalation_flag AS INTEGER)",
             "is_urgent": "CAST(priority = 'Urgent' AS INTEGER)", "is_high": "CAST(priority = 'High' AS INTEGER)",
             "satisfaction_score": "satisfaction_score"}


def _gram_sql():
    parts = []
    for i, a in enumerate(_OLS_NAMES):
        for b in _OLS_NAMES[i:]:
            parts.append(f"SELECT '{a}' AS row_var, '{b}' AS col_var, CAST(sum(CAST({_OLS_EXPR[a]} AS DECIMAL(20,2)) * "
                         f"CAST({_OLS_EXPR[b]} AS DECIMAL(20,2))) AS DOUBLE) AS value FROM rated")
    return "\nUNION ALL\n".join(parts)


register("ols_csat_gram", f"""
WITH {cte('tickets')},
rated AS (SELECT * FROM tickets WHERE satisfaction_score > 0)
{_gram_sql()}""")

# ----------------------------------------------------------------- churn
register("churn_class_balance", with_c360("""
SELECT churn_flag, count(*) AS count, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
FROM c360 GROUP BY churn_flag"""))

SPLIT = """r AS (
  SELECT *, row_number() OVER (PARTITION BY churn_flag ORDER BY md5(CAST(account_id AS VARCHAR) || '-42'), account_id) AS rk,
         count(*) OVER (PARTITION BY churn_flag) AS cn FROM c360),
split AS (
  SELECT *, rk <= floor(cn * 0.2 + 0.5) AS is_test,
         CASE WHEN rk > floor(cn * 0.2 + 0.5) THEN CAST(rk - floor(cn * 0.2 + 0.5) AS BIGINT) END AS train_rank
  FROM r)"""

register("stratified_split", with_c360(", " + SPLIT + """
SELECT account_id, churn_flag, is_test, train_rank FROM split"""))
register("stratified_folds", with_c360(", " + SPLIT + """
SELECT account_id, churn_flag, train_rank, CAST((train_rank - 1) % 5 AS INTEGER) AS fold FROM split WHERE NOT is_test"""))

_NUM = ["seats", "is_trial", "total_mrr", "mrr_per_seat", "total_subscriptions_count",
        "upgrade_count", "downgrade_count", "net_expansion_score", "annual_billing_ratio",
        "total_feature_events", "total_duration_hours", "avg_session_duration_mins",
        "total_errors", "error_rate_per_100_events", "distinct_features_used", "beta_feature_usage_ratio",
        "total_tickets", "avg_csat", "avg_first_response_min", "avg_resolution_hours",
        "total_escalations", "escalation_rate_pct", "urgent_tickets", "urgent_ticket_ratio", "tenure_months"]
_CAT = ["industry", "country", "plan_tier", "referral_source"]

register("standardized_features", with_c360(", " + SPLIT + ",\nst AS (SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)), 0), 1.0) AS s_{c}"
    for c in _NUM) + " FROM split WHERE NOT is_test)\n" + "\nUNION ALL\n".join(
    f"SELECT account_id, '{c}' AS feature, round(coalesce((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, 0.0), 6) AS value "
    f"FROM split, st" for c in _NUM)))

register("onehot_features", with_c360(", " + SPLIT + ",\nlv AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS cat, CAST({c} AS VARCHAR) AS level FROM split WHERE NOT is_test AND {c} IS NOT NULL"
    for c in _CAT) + """),
lv2 AS (SELECT DISTINCT cat, level FROM lv),
keep AS (SELECT cat, level FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY level) AS rn FROM lv2) WHERE rn > 1),
vals AS (""" + "\nUNION ALL\n".join(
    f"SELECT account_id, '{c}' AS cat, CAST({c} AS VARCHAR) AS v FROM split" for c in _CAT) + """)
SELECT vals.account_id, keep.cat || '_' || keep.level AS feature,
       CAST(CASE WHEN vals.v = keep.level THEN 1 ELSE 0 END AS INTEGER) AS value
FROM vals JOIN keep ON vals.cat = keep.cat"""))

_PROBS = "[" + ", ".join(f"{i}/64.0::DOUBLE" for i in range(1, 64)) + "]"

register("boosting_root_histogram", with_c360(", " + SPLIT + """,
pw AS (SELECT CAST(count_if(churn_flag = 0) AS DOUBLE) / CAST(count_if(churn_flag = 1) AS DOUBLE) AS w FROM split),
lv AS (""" + "\nUNION ALL\n".join(
    f"SELECT DISTINCT '{c}' AS cat, CAST({c} AS VARCHAR) AS level FROM split WHERE NOT is_test AND {c} IS NOT NULL" for c in _CAT) + """),
keep AS (SELECT cat, level FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY level) AS rn FROM lv) WHERE rn > 1),
raw AS (""" + "\nUNION ALL\n".join(
    f"SELECT account_id, '{c}' AS cat, CAST({c} AS VARCHAR) AS v FROM split WHERE NOT is_test" for c in _CAT) + """),
vals AS (""" + "\nUNION ALL\n".join(
    f"SELECT account_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM split WHERE NOT is_test" for c in _NUM) + """
UNION ALL SELECT raw.account_id, keep.cat || '_' || keep.level, CASE WHEN raw.v = keep.level THEN 1.0 ELSE 0.0 END FROM raw JOIN keep ON raw.cat = keep.cat),
cuts AS (SELECT feature, list_distinct(quantile_disc(v, """ + _PROBS + """)) AS c FROM vals WHERE v IS NOT NULL GROUP BY feature),
coded AS (SELECT vals.feature, CAST(CASE WHEN v IS NULL THEN 65 ELSE len(list_filter(c, lambda x: x < v)) END AS INTEGER) AS code, account_id
          FROM vals JOIN cuts ON vals.feature = cuts.feature),
gh AS (SELECT account_id, CASE WHEN churn_flag = 1 THEN round(w * 16777216.0 * -0.5) ELSE 8388608.0 END AS g,
              round(CASE WHEN churn_flag = 1 THEN w ELSE 1.0 END * 16777216.0 * 0.25) AS h FROM split, pw WHERE NOT is_test)
SELECT feature, code, CAST(sum(CAST(g AS BIGINT)) AS BIGINT) AS gradient, CAST(sum(CAST(h AS BIGINT)) AS BIGINT) AS hessian
FROM coded JOIN gh ON coded.account_id = gh.account_id GROUP BY feature, code"""))

RULE = """sc AS (SELECT account_id, CAST(churn_flag AS INTEGER) AS y,
                    1.0 / (1.0 + CAST(tenure_months AS DOUBLE) / 12.0) AS score FROM c360)"""

register("binary_metrics", with_c360(", " + RULE + """,
g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY score),
r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
                sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM g),
rk AS (SELECT sum(CAST(neg AS DOUBLE) * (CAST(tp - pos AS DOUBLE) + 0.5 * pos)) AS u,
              sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))) AS ap,
              sum(pos) AS p, sum(neg) AS n FROM r),
c AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives,
             CAST(count_if(y = 1 AND score > 0.5) AS DOUBLE) AS tp, CAST(count_if(y = 0 AND score > 0.5) AS DOUBLE) AS fp,
             CAST(count_if(y = 1 AND NOT score > 0.5) AS DOUBLE) AS fn, CAST(count_if(y = 0 AND NOT score > 0.5) AS DOUBLE) AS tn,
             sum((score - y) * (score - y)) AS sq FROM sc)
SELECT c.n, c.positives, round(rk.u / CAST(rk.p * rk.n AS DOUBLE), 6) AS roc_auc, round(rk.ap / CAST(rk.p AS DOUBLE), 6) AS pr_auc,
       round((c.tp + c.tn) / CAST(c.n AS DOUBLE), 6) AS accuracy,
       round(coalesce(c.tp / nullif(c.tp + c.fp, 0), 0.0), 6) AS precision,
       round(coalesce(c.tp / nullif(c.tp + c.fn, 0), 0.0), 6) AS recall,
       round(coalesce(2.0 * c.tp / nullif(2.0 * c.tp + c.fp + c.fn, 0), 0.0), 6) AS f1_score,
       round(c.sq / CAST(c.n AS DOUBLE), 6) AS brier_score
FROM c, rk"""))

register("confusion_matrix", with_c360(", " + RULE + """
SELECT a.actual, p.predicted, CAST(count(sc.account_id) AS BIGINT) AS count
FROM (VALUES (0), (1)) a(actual) CROSS JOIN (VALUES (0), (1)) p(predicted)
LEFT JOIN sc ON sc.y = a.actual AND CAST(sc.score > 0.5 AS INTEGER) = p.predicted
GROUP BY a.actual, p.predicted"""))
