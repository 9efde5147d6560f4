"""Driver tables -> the six subscription tables the analytics read.

The analytics are written against a subscription star schema (accounts,
subscriptions, feature usage, support tickets, churn events). The test data is
a TPC-H style schema; this module maps it onto the subscription schema with
plain projections, one aggregate and one window, exactly as documented in
FIXTURES.md section B. Every column read is named, so the parquet scan prunes
the rest, and every filter sits on a scan column so it can be pushed down.
"""

from __future__ import annotations

import datetime as _dt
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Fixed values of the mapping (FIXTURES.md B). The reference date replaces the
# reference's 2024-12-31 cut-off: one day after the last order in the data.
REFERENCE_DATE = _dt.date(2001, 8, 2)
NO_ORDER_SIGNUP = _dt.date(1995, 1, 1)
CHURN_GAP_DAYS = 365          # inactive this long after the last order -> churned
REACTIVATION_GAP_DAYS = 900   # a gap longer than this between orders is a churn
REFERRAL_SOURCES = ["ads", "event", "organic", "other", "partner"]  # by custkey % 5
PLAN_TIERS = ["Basic", "Pro", "Enterprise"]                          # by nationkey % 3
FEATURE_BUCKETS = 40
ERROR_COUNT_BY_RETURNFLAG = {"R": 2, "A": 1}                          # others 0
PRIORITY_BY_EVENT_TYPE = {"error": "Urgent", "purchase": "High", "click": "Medium"}  # others Low
ESCALATION_K = 90

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def _lookup(col: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None
                else expr.when(col == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default))


def _by_index(idx: Column, values: list[str]) -> Column:
    return _lookup(idx, dict(enumerate(values)), None)


def orders_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with the order date as DATE and the price as exact DECIMAL(18,2)."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                    "o_orderdate", "o_orderpriority"])
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.to_date("o_orderdate").alias("odate"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dim_accounts: customer x nation x region plus first/last order date."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    # nation (25 rows) and region (5 rows) are fixed-size TPC-H dimensions:
    # their size does not grow with the scale factor, so broadcasting is safe.
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
                      .select("n_nationkey", "r_name"))
    span = (orders_base(spark, sf_dir).groupBy("o_custkey")
            .agg(F.min("odate").alias("first_date"), F.max("odate").alias("last_date")))
    ref = F.lit(REFERENCE_DATE)
    return (cust.join(geo, cust.c_nationkey == geo.n_nationkey, "inner")
            .join(span, cust.c_custkey == span.o_custkey, "left")
            .select(
                F.col("c_custkey").alias("account_id"),
                F.col("c_name").alias("account_name"),
                F.col("c_mktsegment").alias("industry"),
                F.col("r_name").alias("country"),
                F.coalesce("first_date", F.lit(NO_ORDER_SIGNUP)).alias("signup_date"),
                _by_index(F.col("c_custkey") % 5, REFERRAL_SOURCES).alias("referral_source"),
                _by_index(F.col("c_nationkey") % 3, PLAN_TIERS).alias("plan_tier"),
                (F.lit(1) + (F.col("c_custkey") * 7) % 50).cast("bigint").alias("seats"),
                ((F.col("c_custkey") % 7) == 0).alias("is_trial"),
                F.coalesce(F.datediff(ref, F.col("last_date")) > CHURN_GAP_DAYS,
                           F.lit(False)).alias("churn_flag"),
            ))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_subscriptions: one subscription per order."""
    o = orders_base(spark, sf_dir)
    return o.select(
        F.col("o_orderkey").alias("subscription_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("odate").alias("start_date"),
        F.col("price").alias("mrr_amount"),
        F.when(F.col("o_orderstatus") == "F", "annual").otherwise("monthly").alias("billing_frequency"),
        (F.col("o_orderpriority") == "1-URGENT").alias("upgrade_flag"),
        (F.col("o_orderpriority") == "5-LOW").alias("downgrade_flag"),
        (F.col("o_orderstatus") == "P").alias("churn_flag"),
    )


def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_feature_usage: one usage record per line item."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                     "l_returnflag", "l_linestatus"])
    qty = F.col("l_quantity").cast("bigint")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("usage_id"),
        F.col("l_orderkey").alias("subscription_id"),
        F.concat(F.lit("feature_"), (F.col("l_partkey") % FEATURE_BUCKETS).cast("string")).alias("feature_name"),
        qty.alias("usage_count"),
        (qty * 60).alias("usage_duration_secs"),
        _lookup(F.col("l_returnflag"), ERROR_COUNT_BY_RETURNFLAG, 0).cast("bigint").alias("error_count"),
        (F.col("l_linestatus") == "O").alias("is_beta_feature"),
    )


def support_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_support_tickets: one ticket per event; k is the integer at $.k."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        F.col("event_id").alias("ticket_id"),
        F.col("user_id").alias("account_id"),
        (F.floor("value").cast("bigint") % 6).alias("satisfaction_score"),
        # minutes carry two decimals; DECIMAL keeps sums exact and order-free
        F.col("value").cast("decimal(18,2)").alias("first_response_time_minutes"),
        k.cast("double").alias("resolution_time_hours"),
        _lookup(F.col("event_type"), PRIORITY_BY_EVENT_TYPE, "Low").alias("priority"),
        (k >= ESCALATION_K).alias("escalation_flag"),
    )


def churn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_churn_events: an order ends a life cycle if it is the last one and
    older than a year at the reference date, or if the next order of the same
    customer comes more than 900 days later (a reactivation).

    In (date, orderkey) order only the last order of a (customer, day) can
    qualify -- any earlier order of that day is followed the same day. So the
    orders are reduced to one row per (customer, day) (partial aggregation
    map-side) and the next order day comes from a window over that table,
    whose size per customer is bounded by the number of days: a customer with
    a large share of all orders does not put those orders into one task."""
    o = orders_base(spark, sf_dir)
    last = F.struct("o_orderkey", "o_orderpriority", "price")
    days = (o.groupBy("o_custkey", "odate")
            .agg(F.max_by(last, F.col("o_orderkey")).alias("_last")))
    w = Window.partitionBy("o_custkey").orderBy("odate")
    nxt = days.withColumn("next_date", F.lead("odate").over(w))
    keep = ((F.col("next_date").isNull() & (F.datediff(F.lit(REFERENCE_DATE), F.col("odate")) > CHURN_GAP_DAYS))
            | (F.datediff(F.col("next_date"), F.col("odate")) > REACTIVATION_GAP_DAYS))
    return nxt.where(keep).select(
        F.col("_last.o_orderkey").alias("churn_event_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("_last.o_orderpriority").alias("reason_code"),
        F.col("_last.price").alias("refund_amount_usd"),
        F.col("next_date").isNotNull().alias("is_reactivation"),
        F.date_add(F.col("odate"), CHURN_GAP_DAYS).alias("churn_date"),
    )


@dataclass
class SubscriptionTables:
    """The six-table star schema (dim_date is never used by any analysis)."""
    accounts: DataFrame
    subscriptions: DataFrame
    usage: DataFrame
    tickets: DataFrame
    churn: DataFrame
    reference_date: _dt.date = REFERENCE_DATE


def load_tables(spark: SparkSession, sf_dir: str) -> SubscriptionTables:
    return SubscriptionTables(
        accounts=accounts(spark, sf_dir),
        subscriptions=subscriptions(spark, sf_dir),
        usage=feature_usage(spark, sf_dir),
        tickets=support_tickets(spark, sf_dir),
        churn=churn_events(spark, sf_dir),
    )
