"""Edge cases the driver tables do not exercise (FIXTURES.md lists them),
on a small hand-made subscription fixture."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from retentia.operators import cohort as coh
from retentia.operators import features as feat
from retentia.operators import metrics as met
from retentia.operators import revenue as rev
from retentia.operators import survival as surv
from retentia.sources.tables import SubscriptionTables

D = dt.date
REF = D(2021, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    accounts = spark.createDataFrame([
        (1, "a1", "x", "US", D(2020, 1, 15), "ads", "Basic", 0, False, False),     # zero seats
        (2, "a2", "x", "US", D(2020, 2, 10), "ads", "Pro", 5, False, True),        # only unrated tickets
        (3, "a3", "y", "DE", D(2020, 3, 1), "event", "Enterprise", 3, True, False),  # no subscription
        (4, "a4", "y", "DE", D(2020, 1, 20), "event", "Basic", 2, False, False),  # sub before signup
        (5, "a5", "y", "FR", D(2020, 5, 10), "other", "Enterprise", 1, False, False),  # cohort w/o index 0
    ], "account_id bigint, account_name string, industry string, country string, signup_date date, "
       "referral_source string, plan_tier string, seats bigint, is_trial boolean, churn_flag boolean")
    subs = spark.createDataFrame([
        (11, 1, D(2020, 1, 20), 100.00, "annual", True, False, False),
        (12, 1, D(2020, 3, 5), 50.50, "monthly", False, True, False),
        (13, 2, D(2020, 2, 11), 200.00, "monthly", False, False, True),
        (14, 4, D(2019, 12, 1), 10.00, "monthly", False, False, False),
        (15, 5, D(2020, 7, 2), 30.00, "annual", False, False, False),
    ], "subscription_id bigint, account_id bigint, start_date date, mrr_amount double, "
       "billing_frequency string, upgrade_flag boolean, downgrade_flag boolean, churn_flag boolean"
    ).withColumn("mrr_amount", F.col("mrr_amount").cast("decimal(18,2)"))
    usage = spark.createDataFrame([
        (101, 11, "f_a", 1, 3600, 2, True),
        (102, 11, "f_b", 2, 1800, 0, False),
        (103, 99, "f_a", 5, 60, 1, False),  # unknown subscription: no account
    ], "usage_id bigint, subscription_id bigint, feature_name string, usage_count bigint, "
       "usage_duration_secs bigint, error_count bigint, is_beta_feature boolean")
    tickets = spark.createDataFrame([
        (201, 2, 0, 10.0, 5.0, "Low", False),
        (202, 2, None, 20.0, 7.0, "Low", False),
        (203, 1, 4, 30.0, 2.0, "Urgent", True),
        (204, 1, 2, 40.0, 4.0, "High", False),
    ], "ticket_id bigint, account_id bigint, satisfaction_score int, first_response_time_minutes double, "
       "resolution_time_hours double, priority string, escalation_flag boolean"
    ).withColumn("first_response_time_minutes", F.col("first_response_time_minutes").cast("decimal(18,2)"))
    churn = spark.createDataFrame([
        (301, 2, "price", 10.00, False, D(2020, 6, 1)),
        (302, 2, None, 5.00, True, D(2020, 5, 1)),
    ], "churn_event_id bigint, account_id bigint, reason_code string, refund_amount_usd double, "
       "is_reactivation boolean, churn_date date"
    ).withColumn("refund_amount_usd", F.col("refund_amount_usd").cast("decimal(18,2)"))
    return SubscriptionTables(accounts, subs, usage, tickets, churn, REF)


@pytest.fixture(scope="module")
def c360(tables):
    return {r["account_id"]: r for r in feat.customer_360(tables).collect()}


def test_zero_seats_and_no_subscription(c360):
    assert c360[1]["mrr_per_seat"] == pytest.approx(150.5)          # seats 0 -> divide by 1
    assert c360[3]["total_mrr"] == 0.0 and c360[3]["total_subscriptions_count"] == 0
    assert c360[3]["avg_sub_mrr"] is None and c360[3]["mrr_per_seat"] == 0.0


def test_usage_without_account_is_dropped(c360):
    assert c360[1]["total_feature_events"] == 2
    assert c360[1]["total_errors"] == 2
    assert c360[1]["distinct_features_used"] == 2


def test_unrated_tickets_fall_back_to_global_mean(c360):
    # rated tickets overall: 4 and 2 -> 3.0; account 2 has none rated
    assert c360[2]["avg_csat"] == pytest.approx(3.0)
    assert c360[2]["min_csat"] is None and c360[2]["total_tickets"] == 2
    # no tickets at all: global ticket means
    assert c360[3]["avg_first_response_min"] == pytest.approx(25.0)
    assert c360[3]["avg_resolution_hours"] == pytest.approx(4.5)


def test_churn_first_non_null_and_tenure(c360):
    # earliest churn date wins for the date; the reason skips the NULL one
    assert c360[2]["churn_date"] == D(2020, 5, 1)
    assert c360[2]["churn_reason"] == "price"
    assert c360[2]["refund_amount_usd"] == pytest.approx(15.0)
    assert c360[2]["tenure_days"] == (D(2020, 5, 1) - D(2020, 2, 10)).days
    assert c360[1]["tenure_days"] == (REF - D(2020, 1, 15)).days


def test_cohort_negative_index_and_missing_index_zero(tables):
    rows = {(r["signup_cohort"], r["cohort_index"]): r
            for r in coh.cohort_retention(tables.subscriptions, tables.accounts).collect()}
    assert ("2020-01", -1) not in rows                      # account 4's early subscription
    assert rows[("2020-05", 2)]["retention_pct"] is None     # cohort without index 0
    assert rows[("2020-01", 0)]["retention_pct"] == 100.0
    assert rows[("2020-01", 2)]["retention_pct"] == 100.0


def test_forecast_floor(spark):
    fit = spark.createDataFrame([(3, -1.0e6, 0.0, D(2020, 12, 1), 1000.0)],
                                "n bigint, slope double, intercept double, last_month date, "
                                "last_cumulative_mrr double")
    out = rev.trend_forecast(fit).orderBy("forecast_month").collect()
    assert [r["projected_mrr_added"] for r in out] == [100000.0] * 12
    assert out[0]["forecast_month"] == "2021-01"
    assert out[0]["projected_total_mrr"] == pytest.approx(1000.0 * 0.982 + 100000.0)


def test_all_censored_group_and_ties(spark):
    df = spark.createDataFrame([("A", 1.0, 0), ("A", 1.0, 0), ("A", 2.0, 0),
                                ("B", 1.0, 1), ("B", 1.0, 1), ("B", 2.0, 0), ("B", 3.0, 1)],
                               "g string, t double, e int")
    km = {(r["g"], r["t"]): r["survival"] for r in surv.kaplan_meier(df, "t", "e", ["g"]).collect()}
    assert km[("A", 1.0)] == 1.0 and km[("A", 2.0)] == 1.0 and km[("A", 0.0)] == 1.0
    assert km[("B", 1.0)] == pytest.approx(0.5)          # 2 of 4 at risk die at t = 1
    assert km[("B", 3.0)] == 0.0


def test_single_class_metrics(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7), (0, 0.4)], "y int, s double")
    r = met.binary_metrics(df, "y", "s").first()
    assert r["roc_auc"] is None and r["pr_auc"] is None
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1_score"] == 0.0
    assert r["accuracy"] == pytest.approx(2 / 3, abs=1e-6)


def test_ridge_reads_its_matrix_once(spark):
    from retentia.operators import revenue as rev
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    schema = ", ".join(f"{c} double" for c in [*rev.LTV_DRIVER_FEATURES, "y"])
    rows = [tuple(float((i * (j + 3)) % 11) for j in range(len(rev.LTV_DRIVER_FEATURES) + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    assert rev.ridge_drivers(df, target="y").count() == len(rev.LTV_DRIVER_FEATURES)
    assert seen.value == 40
