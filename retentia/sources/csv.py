"""Readers for the raw subscription tables as CSV files.

The reference keeps its six raw tables as CSV with a header row. Schemas are
declared here -- no ``inferSchema`` (a second pass over the data, and types
that change with the data).
"""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SubscriptionTables

SCHEMAS = {  # the columns the analyses read (SURVEY section 1)
    "dim_accounts": ("account_id STRING, account_name STRING, industry STRING, country STRING, "
                     "signup_date DATE, referral_source STRING, plan_tier STRING, seats INT, "
                     "is_trial BOOLEAN, churn_flag BOOLEAN"),
    "fact_subscriptions": ("subscription_id STRING, account_id STRING, start_date DATE, "
                           "mrr_amount DECIMAL(18,2), billing_frequency STRING, upgrade_flag BOOLEAN, "
                           "downgrade_flag BOOLEAN, churn_flag BOOLEAN"),
    "fact_feature_usage": ("usage_id STRING, subscription_id STRING, feature_name STRING, "
                           "usage_count BIGINT, usage_duration_secs BIGINT, error_count BIGINT, "
                           "is_beta_feature BOOLEAN"),
    "fact_support_tickets": ("ticket_id STRING, account_id STRING, satisfaction_score INT, "
                             "first_response_time_minutes DECIMAL(18,6), resolution_time_hours DOUBLE, "
                             "priority STRING, escalation_flag BOOLEAN"),
    "fact_churn_events": ("churn_event_id STRING, account_id STRING, reason_code STRING, "
                          "refund_amount_usd DECIMAL(18,2), is_reactivation BOOLEAN, churn_date DATE"),
}


OPTIONAL = {"churn_event_id"}  # the only declared column a file may lack


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with a declared schema. Columns are matched by header name,
    so files may carry the declared columns in any order or extra columns; a
    missing one is an error, as a NULL column would pass for real data."""
    header = spark.read.option("header", True).csv(path).columns
    declared = [c.strip().split(" ", 1) for c in _split_schema(schema)]
    want = {n: t for n, t in declared}
    missing = [n for n in want if n not in header and n not in OPTIONAL]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(header)}")
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    cols = [F.col(f"`{n}`").cast(want[n]).alias(n) if n in header else F.lit(None).cast(want[n]).alias(n)
            for n, _ in declared]
    return raw.select(*cols)


def _split_schema(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    if cur.strip():
        out.append(cur)
    return [c.strip() for c in out]


def load_csv_tables(spark: SparkSession, data_dir: str, reference_date: datetime.date) -> SubscriptionTables:
    """The subscription tables from ``<data_dir>/<name>.csv`` files. The
    reference date ends the tenure of active accounts: it belongs to the data,
    so there is no default."""
    def rd(name):
        return read_csv(spark, os.path.join(data_dir, f"{name}.csv"), SCHEMAS[name])

    return SubscriptionTables(
        accounts=rd("dim_accounts"), subscriptions=rd("fact_subscriptions"),
        usage=rd("fact_feature_usage"), tickets=rd("fact_support_tickets"),
        churn=rd("fact_churn_events"), reference_date=reference_date)
