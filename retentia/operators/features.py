"""Customer-360 feature matrix: one row per account.

Four per-account aggregates (subscriptions, usage, tickets, churn events) are
computed where the data lives -- partial aggregation map-side, one shuffle on
the grouping key -- and left-joined onto the accounts. All aggregates are
hash-partitioned on ``account_id``, so the join chain re-uses that partitioning
instead of shuffling the accounts once per join.

Two formula sets exist in the reference: the script (variant ``a``, the plain
names) and the notebook (variant ``b``). Both are built.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from ..functions.exprs import (as_double, count_true, exact_mean, floor1_ratio, money,
                               safe_div, stable_mean, tenure_months, zero_as_one_ratio)

ACCOUNT_COLUMNS = ["account_id", "account_name", "industry", "country", "signup_date",
                   "referral_source", "plan_tier", "seats", "is_trial", "churn_flag"]


# --------------------------------------------------------------------------- A1
def subscription_features(subs: DataFrame) -> DataFrame:
    """Per-account subscription revenue, counts and dates."""
    agg = subs.where(F.col("account_id").isNotNull()).groupBy("account_id").agg(
        money(F.sum("mrr_amount")).alias("total_mrr"),
        exact_mean("mrr_amount").alias("avg_sub_mrr"),
        money(F.max("mrr_amount")).alias("max_sub_mrr"),
        F.count("subscription_id").alias("total_subscriptions_count"),
        count_true("upgrade_flag").alias("upgrade_count"),
        count_true("downgrade_flag").alias("downgrade_count"),
        count_true(F.col("billing_frequency") == "annual").alias("annual_billing_count"),
        count_true(F.col("billing_frequency") == "monthly").alias("monthly_billing_count"),
        F.min("start_date").alias("first_sub_date"),
        F.max("start_date").alias("last_sub_date"),
    )
    return agg.withColumns({
        "net_expansion_score": F.col("upgrade_count") - F.col("downgrade_count"),
        "annual_billing_ratio": safe_div("annual_billing_count", "total_subscriptions_count"),
    })


# --------------------------------------------------------------------------- J1
def usage_with_account(usage: DataFrame, subs: DataFrame) -> DataFrame:
    """Bring account_id onto each usage row (left join, N:1 on subscription); the co-located usage table has it already."""
    if "account_id" in usage.columns:
        return usage
    return usage.join(subs.select("subscription_id", "account_id"), "subscription_id", "left")


# --------------------------------------------------------------------------- A2
def usage_features(usage: DataFrame, subs: DataFrame) -> DataFrame:
    """Per-account product usage (A2, E3). Usage rows whose subscription is
    unknown have no account and are dropped, as a keyed group-by drops them."""
    u = usage_with_account(usage, subs).where(F.col("account_id").isNotNull())
    agg = u.groupBy("account_id").agg(
        F.count("usage_id").alias("total_feature_events"),
        (as_double(F.sum("usage_duration_secs")) / 3600.0).alias("total_duration_hours"),
        (exact_mean("usage_duration_secs") / 60.0).alias("avg_session_duration_mins"),
        F.sum("error_count").cast("bigint").alias("total_errors"),
        F.countDistinct("feature_name").alias("distinct_features_used"),
        count_true("is_beta_feature").alias("beta_feature_events"),
    )
    return agg.withColumns({
        "error_rate_per_100_events": floor1_ratio("total_errors", "total_feature_events") * 100.0,
        "beta_feature_usage_ratio": floor1_ratio("beta_feature_events", "total_feature_events"),
    })


# --------------------------------------------------------------------------- A3/A4
def ticket_features(tickets: DataFrame) -> DataFrame:
    """Per-account support features (A3, A4): rated-only CSAT, SLA means,
    escalation and priority counts, ratios with a floor-1 denominator."""
    rated = F.when(F.col("satisfaction_score") > 0, F.col("satisfaction_score"))
    agg = tickets.where(F.col("account_id").isNotNull()).groupBy("account_id").agg(
        F.count("ticket_id").alias("total_tickets"),
        exact_mean(rated).alias("avg_csat"),
        F.min(rated).cast("bigint").alias("min_csat"),
        exact_mean("first_response_time_minutes").alias("avg_first_response_min"),
        exact_mean("resolution_time_hours").alias("avg_resolution_hours"),
        count_true("escalation_flag").alias("total_escalations"),
        count_true(F.col("priority") == "Urgent").alias("urgent_tickets"),
        count_true(F.col("priority") == "High").alias("high_tickets"),
    )
    return agg.withColumns({
        "escalation_rate_pct": floor1_ratio("total_escalations", "total_tickets") * 100.0,
        "urgent_ticket_ratio": floor1_ratio(F.col("urgent_tickets") + F.col("high_tickets"), "total_tickets"),
    })


def ticket_fill_values(tickets: DataFrame) -> DataFrame:
    """One row: ticket-level means used to fill accounts without tickets
    (rated CSAT, first response, resolution). A global aggregate: partial
    per task, one row per task shuffled."""
    rated = F.when(F.col("satisfaction_score") > 0, F.col("satisfaction_score"))
    return tickets.agg(exact_mean(rated).alias("g_csat"),
                       exact_mean("first_response_time_minutes").alias("g_resp"),
                       exact_mean("resolution_time_hours").alias("g_resol"))


# --------------------------------------------------------------------------- A5
def churn_features(churn: DataFrame) -> DataFrame:
    """Per-account churn detail (A5). "First" reason/date = the earliest
    non-null value by (churn_date, churn_event_id); refunds summed; any
    reactivation."""
    order_key = F.struct("churn_date", "churn_event_id")

    def first_non_null(c: str):
        present = F.col(c).isNotNull()
        return F.min_by(F.when(present, F.col(c)), F.when(present, order_key))

    return churn.where(F.col("account_id").isNotNull()).groupBy("account_id").agg(
        first_non_null("reason_code").alias("churn_reason"),
        money(F.sum("refund_amount_usd")).alias("refund_amount_usd"),
        F.coalesce(F.bool_or("is_reactivation"), F.lit(False)).alias("is_reactivation"),
        first_non_null("churn_date").alias("churn_date"),
    )


# --------------------------------------------------------------------------- P1
C360_COLUMNS = ACCOUNT_COLUMNS + [
    "total_mrr", "avg_sub_mrr", "max_sub_mrr", "total_subscriptions_count", "upgrade_count",
    "downgrade_count", "annual_billing_count", "monthly_billing_count", "first_sub_date",
    "last_sub_date", "net_expansion_score", "annual_billing_ratio",
    "total_feature_events", "total_duration_hours", "avg_session_duration_mins", "total_errors",
    "distinct_features_used", "beta_feature_events", "error_rate_per_100_events",
    "beta_feature_usage_ratio",
    "total_tickets", "avg_csat", "min_csat", "avg_first_response_min", "avg_resolution_hours",
    "total_escalations", "urgent_tickets", "high_tickets", "escalation_rate_pct",
    "urgent_ticket_ratio",
    "churn_reason", "refund_amount_usd", "is_reactivation", "churn_date",
    "mrr_per_seat", "signup_dt", "churn_dt", "tenure_days", "tenure_months",
]


def customer_360(tables, ref_date: _dt.date | None = None) -> DataFrame:
    """The 49-column Customer-360 matrix, script formulas (variant a).

    Fills: counts and ratios with 0; CSAT, first response and resolution with
    ticket-level global means; min_csat, high_tickets, beta_feature_events,
    billing counts, dates and churn detail stay NULL. Tenure runs from signup
    to the churn date if any, else to the reference date, at least one day.
    """
    ref = ref_date or tables.reference_date
    subs_f = subscription_features(tables.subscriptions)
    usage_f = usage_features(tables.usage, tables.subscriptions)
    tick_f, glob = ticket_features(tables.tickets), ticket_fill_values(tables.tickets)
    churn_f = churn_features(tables.churn)

    m = (tables.accounts
         .join(subs_f, "account_id", "left")
         .join(usage_f, "account_id", "left")
         .join(tick_f, "account_id", "left")
         .join(churn_f, "account_id", "left")
         .crossJoin(F.broadcast(glob)))  # one row, size fixed

    zero_l, zero_d = F.lit(0).cast("bigint"), F.lit(0.0)
    filled = m.withColumns({
        "total_mrr": F.coalesce("total_mrr", zero_d),
        "total_subscriptions_count": F.coalesce("total_subscriptions_count", zero_l),
        "upgrade_count": F.coalesce("upgrade_count", zero_l),
        "downgrade_count": F.coalesce("downgrade_count", zero_l),
        "net_expansion_score": F.coalesce("net_expansion_score", zero_l),
        "annual_billing_ratio": F.coalesce("annual_billing_ratio", zero_d),
        "total_feature_events": F.coalesce("total_feature_events", zero_l),
        "total_duration_hours": F.coalesce("total_duration_hours", zero_d),
        "avg_session_duration_mins": F.coalesce("avg_session_duration_mins", zero_d),
        "total_errors": F.coalesce("total_errors", zero_l),
        "error_rate_per_100_events": F.coalesce("error_rate_per_100_events", zero_d),
        "distinct_features_used": F.coalesce("distinct_features_used", zero_l),
        "beta_feature_usage_ratio": F.coalesce("beta_feature_usage_ratio", zero_d),
        "avg_csat": F.coalesce("avg_csat", "g_csat"),
        "total_tickets": F.coalesce("total_tickets", zero_l),
        "avg_first_response_min": F.coalesce("avg_first_response_min", "g_resp"),
        "avg_resolution_hours": F.coalesce("avg_resolution_hours", "g_resol"),
        "total_escalations": F.coalesce("total_escalations", zero_l),
        "escalation_rate_pct": F.coalesce("escalation_rate_pct", zero_d),
        "urgent_tickets": F.coalesce("urgent_tickets", zero_l),
        "urgent_ticket_ratio": F.coalesce("urgent_ticket_ratio", zero_d),
        "refund_amount_usd": F.coalesce("refund_amount_usd", zero_d),
        "churn_flag": F.col("churn_flag").cast("bigint"),
        "is_trial": F.col("is_trial").cast("bigint"),
        "seats": F.col("seats").cast("bigint"),
    })
    days = F.greatest(F.datediff(F.coalesce(F.col("churn_date"), F.lit(ref)), F.col("signup_date")),
                      F.lit(1))
    out = filled.withColumns({
        "mrr_per_seat": floor1_ratio("total_mrr", "seats"),
        "signup_dt": F.col("signup_date"),
        "churn_dt": F.col("churn_date"),
        "tenure_days": F.when(F.col("signup_date").isNotNull(), days).cast("bigint"),
    }).withColumn("tenure_months", tenure_months("tenure_days"))
    return out.select(*C360_COLUMNS)


def tenure(c360: DataFrame) -> DataFrame:
    return c360.select("account_id", "signup_date", "churn_date", "churn_flag", "tenure_days",
                       "tenure_months")


# --------------------------------------------------------------------------- variant b
C360_B_COLUMNS = ACCOUNT_COLUMNS + [
    "total_mrr", "total_subscriptions_count", "upgrade_count", "downgrade_count",
    "annual_billing_count", "first_sub_date", "last_sub_date", "net_expansion_score",
    "annual_billing_ratio",
    "total_feature_events", "total_usage_volume", "total_duration_hours", "total_errors",
    "distinct_features_used", "beta_feature_events", "avg_session_duration_mins",
    "error_rate_per_100_events", "beta_feature_usage_ratio",
    "total_tickets", "avg_csat", "avg_first_response_min", "avg_resolution_hours",
    "total_escalations", "urgent_tickets", "escalation_rate_pct", "urgent_ticket_ratio",
    "tenure_months", "mrr_per_seat",
]


def customer_360_variant_b(tables, ref_date: _dt.date | None = None,
                           median=None) -> DataFrame:
    """Notebook formulas: no churn block; urgent-only ratio; zero-replaced
    denominators; tenure always to the reference date (no clip); CSAT filled
    with the mean of account averages, response/resolution with the exact
    median of account averages; then every remaining numeric NULL -> 0
    (string and date columns stay NULL)."""
    from .quantiles import exact_median  # noqa: WPS433 (cyclic import guard)
    median = median or exact_median
    ref = ref_date or tables.reference_date
    subs = tables.subscriptions
    s = subs.groupBy("account_id").agg(
        money(F.sum("mrr_amount")).alias("total_mrr"),
        F.count("subscription_id").alias("total_subscriptions_count"),
        count_true("upgrade_flag").alias("upgrade_count"),
        count_true("downgrade_flag").alias("downgrade_count"),
        count_true(F.col("billing_frequency") == "annual").alias("annual_billing_count"),
        F.min("start_date").alias("first_sub_date"),
        F.max("start_date").alias("last_sub_date"),
    ).withColumns({
        "net_expansion_score": F.col("upgrade_count") - F.col("downgrade_count"),
        "annual_billing_ratio": safe_div("annual_billing_count", "total_subscriptions_count"),
    })
    u = (usage_with_account(tables.usage, subs).where(F.col("account_id").isNotNull())
         .groupBy("account_id").agg(
             F.count("usage_id").alias("total_feature_events"),
             F.sum("usage_count").cast("bigint").alias("total_usage_volume"),
             (as_double(F.sum("usage_duration_secs")) / 3600.0).alias("total_duration_hours"),
             F.sum("error_count").cast("bigint").alias("total_errors"),
             F.countDistinct("feature_name").alias("distinct_features_used"),
             count_true("is_beta_feature").alias("beta_feature_events"),
         ).withColumns({
             "avg_session_duration_mins": zero_as_one_ratio(F.col("total_duration_hours") * 60.0,
                                                            "total_feature_events"),
             "error_rate_per_100_events": zero_as_one_ratio("total_errors", "total_feature_events") * 100.0,
             "beta_feature_usage_ratio": zero_as_one_ratio("beta_feature_events", "total_feature_events"),
         }))
    rated = F.when(F.col("satisfaction_score") > 0, F.col("satisfaction_score"))
    t = (tables.tickets.where(F.col("account_id").isNotNull()).groupBy("account_id").agg(
        F.count("ticket_id").alias("total_tickets"),
        exact_mean(rated).alias("avg_csat"),
        exact_mean("first_response_time_minutes").alias("avg_first_response_min"),
        exact_mean("resolution_time_hours").alias("avg_resolution_hours"),
        count_true("escalation_flag").alias("total_escalations"),
        count_true(F.col("priority") == "Urgent").alias("urgent_tickets"),
    ).withColumns({
        "escalation_rate_pct": zero_as_one_ratio("total_escalations", "total_tickets") * 100.0,
        "urgent_ticket_ratio": zero_as_one_ratio("urgent_tickets", "total_tickets"),
    }))
    m = (tables.accounts.join(s, "account_id", "left").join(u, "account_id", "left")
         .join(t, "account_id", "left")
         .withColumns({
             "tenure_months": tenure_months(F.datediff(F.lit(ref), F.col("signup_date"))),
             "mrr_per_seat": zero_as_one_ratio("total_mrr", "seats"),
             "seats": F.col("seats").cast("bigint"),
             "is_trial": F.col("is_trial").cast("bigint"),
             "churn_flag": F.col("churn_flag").cast("bigint"),
         }))
    # fill values are statistics over the joined matrix (accounts that have
    # tickets): one-row aggregates, broadcast to every row. The matrix feeds
    # five branches (mean, two three-pass medians, the result), so it is
    # materialised once rather than recomputed from the fact tables.
    m = reliable_checkpoint(m)
    fills = (m.agg(stable_mean("avg_csat").alias("f_csat"))
             .crossJoin(median(m, "avg_first_response_min").withColumnRenamed("median", "f_resp"))
             .crossJoin(median(m, "avg_resolution_hours").withColumnRenamed("median", "f_resol")))
    m = m.crossJoin(F.broadcast(fills)).withColumns({
        "avg_csat": F.coalesce("avg_csat", "f_csat"),
        "avg_first_response_min": F.coalesce("avg_first_response_min", "f_resp"),
        "avg_resolution_hours": F.coalesce("avg_resolution_hours", "f_resol"),
    })
    numeric = {f.name: f.dataType.simpleString() for f in m.schema.fields}
    zero_fill = {c: F.coalesce(F.col(c), F.lit(0).cast(numeric[c])) for c in C360_B_COLUMNS
                 if numeric[c] in ("bigint", "int", "double")}
    return m.withColumns(zero_fill).select(*C360_B_COLUMNS)
