"""Lifetime value, monthly recurring revenue and the 12-month forecasts.

The data-sized work is two aggregations (per account, per month); the trend
fit, the forecast recurrences and the headline are computed on one-row or
per-month tables with SQL expressions and higher-order array functions, so
nothing is collected to the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import month_label, round_money, stable_mean
from ..session import write_once
from .quantiles import exact_median

# Fixed values of the reference's formulas.
GROSS_MARGIN = 0.80
MONTHLY_CHURN = 0.0183          # expected-LTV churn rate
FORECAST_HORIZON = 12
FORECAST_FLOOR = 100000.0       # minimum projected monthly addition
RETENTION_FACTOR = 0.982        # 1.8% monthly leakage in the trend forecast
EXPANSION_RATE = 0.058          # notebook compounding forecast
COMPOUND_CHURN = 0.018
VARIANT_B_NO_CHURN_MONTHS = 24  # expected LTV when a tier has no churn
LTV_DRIVER_FEATURES = ["seats", "is_trial", "total_feature_events", "total_duration_hours",
                       "total_errors", "distinct_features_used", "total_tickets", "avg_csat"]


# ------------------------------------------------------------------ L1, L2
def ltv_accounts(c360: DataFrame, gross_margin: float = GROSS_MARGIN,
                 monthly_churn: float = MONTHLY_CHURN) -> DataFrame:
    """Realized LTV (all subscription MRR of the account, 0 if none) and the
    formula LTV total_mrr * margin / churn. Realized LTV is by definition the
    C360 ``total_mrr`` (same sum, same zero fill), so it is taken from there
    instead of aggregating the subscriptions a second time."""
    return c360.select(
        "account_id", "plan_tier", "churn_flag", "tenure_months", "total_mrr",
        F.col("total_mrr").alias("realized_lifetime_value_usd"),
        (F.col("total_mrr") * gross_margin / monthly_churn).alias("expected_ltv_usd"),
    )


# ------------------------------------------------------------------ L3
def ltv_by_tier(ltv: DataFrame) -> DataFrame:
    """Per tier: accounts, mean MRR / realized / expected LTV, median tenure,
    all at two decimals."""
    ltv = ltv.where(F.col("plan_tier").isNotNull())
    agg = ltv.groupBy("plan_tier").agg(
        F.count("account_id").alias("account_count"),
        round_money(stable_mean("total_mrr", 2)).alias("avg_mrr"),
        round_money(stable_mean("realized_lifetime_value_usd", 2)).alias("avg_realized_ltv"),
        round_money(stable_mean("expected_ltv_usd", 6)).alias("avg_expected_ltv"),
    )
    med = exact_median(ltv, "tenure_months", ["plan_tier"], name="median_tenure_months")
    return (agg.join(med, "plan_tier", "left")
            .withColumn("median_tenure_months", round_money("median_tenure_months")))


# ------------------------------------------------------------------ L4
def ltv_by_tier_variant_b(c360b: DataFrame) -> DataFrame:
    """Notebook tier table: realized = avg MRR x median tenure, expected =
    avg MRR / churn rate (x24 when no churn), printed as strings."""
    c360b = write_once(c360b.where(F.col("plan_tier").isNotNull())
                       .select("plan_tier", "total_mrr", "churn_flag", "tenure_months"), "tiers")
    agg = c360b.groupBy("plan_tier").agg(
        F.count(F.lit(1)).alias("accounts"),
        stable_mean("total_mrr", 2).alias("_avg_mrr"),
        (F.sum("churn_flag").cast("double") / F.count("churn_flag").cast("double")).alias("_churn"),
    )
    med = exact_median(c360b, "tenure_months", ["plan_tier"], name="_med")
    j = agg.join(med, "plan_tier", "left")
    realized = F.col("_avg_mrr") * F.col("_med")
    expected = F.when(F.col("_churn") > 0, F.col("_avg_mrr") / F.col("_churn")).otherwise(
        F.col("_avg_mrr") * float(VARIANT_B_NO_CHURN_MONTHS))

    def dollars(c):
        return F.concat(F.lit("$"), F.format_number(F.round(c.cast("decimal(38,8)"), 2), 2))

    def fixed1(c, suffix=""):
        # one decimal, rounded half-up on the decimal form, printed exactly
        return F.concat(F.round(c.cast("decimal(38,8)"), 1).cast("decimal(38,1)").cast("string"),
                        F.lit(suffix))

    return j.select(
        "plan_tier", "accounts",
        dollars(F.col("_avg_mrr")).alias("avg_mrr"),
        fixed1(F.col("_med")).alias("median_tenure_mo"),
        dollars(realized).alias("realized_ltv"),
        fixed1(F.col("_churn") * 100.0, "%").alias("annual_churn_pct"),
        dollars(expected).alias("expected_ltv"),
    )


# ------------------------------------------------------------------ L6, W1
def monthly_mrr(subs: DataFrame) -> DataFrame:
    """MRR added per start month, running total and ARR. Months without new
    subscriptions are absent (as in the reference). The running sum is a
    window over the month table -- one row per calendar month, so its size
    is bounded by the time span, not by the data."""
    m = (subs.groupBy(F.trunc("start_date", "MM").alias("month"))
         .agg(F.sum("mrr_amount").alias("_added")))
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum("_added").over(w)
    return m.select(
        "month", month_label("month").alias("month_str"),
        F.col("_added").cast("double").alias("mrr_added"),
        cum.cast("double").alias("cumulative_mrr"),
        (cum * 12).cast("double").alias("cumulative_arr"),
        (F.row_number().over(Window.orderBy("month")) - 1).cast("bigint").alias("t"),
    )


# ------------------------------------------------------------------ L7, W2
def trend_fit(mrr: DataFrame) -> DataFrame:
    """Least-squares line of mrr_added on the 0-based month index t, from
    exact sums: slope = (nSty - StSy) / (nStt - St^2), intercept =
    (Sy Stt - St Sty) / (nStt - St^2). The sums are DECIMAL/integer, so the
    result does not depend on row order. One row: n, slope, intercept,
    last month, last cumulative MRR."""
    y = F.col("mrr_added").cast("decimal(38,2)")
    t = F.col("t").cast("decimal(38,0)")
    s = mrr.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(t).alias("st"), F.sum(t * t).alias("stt"),
        F.sum(y).alias("sy"), F.sum(t * y).alias("sty"),
        F.max("month").alias("last_month"),
        F.max_by("cumulative_mrr", "month").alias("last_cumulative_mrr"),
    )
    den = (F.col("n") * F.col("stt") - F.col("st") * F.col("st")).cast("double")
    slope = F.try_divide((F.col("n") * F.col("sty") - F.col("st") * F.col("sy")).cast("double"), den)
    icpt = F.try_divide((F.col("sy") * F.col("stt") - F.col("st") * F.col("sty")).cast("double"), den)
    return s.select("n", slope.alias("slope"), icpt.alias("intercept"),
                    "last_month", "last_cumulative_mrr")


# ------------------------------------------------------------------ L8
def trend_forecast(fit: DataFrame, horizon: int = FORECAST_HORIZON, floor: float = FORECAST_FLOOR,
                   retention: float = RETENTION_FACTOR) -> DataFrame:
    """added_k = round2(max(slope*t + intercept, floor)) for t = n..n+h-1;
    total_k = total_{k-1} * retention + added_k from the last cumulative MRR;
    both rounded at two decimals, ARR = round2(total) * 12. The recurrence
    is a left fold (``aggregate``) over the h additions: the same order of
    operations as a loop, without leaving the JVM."""
    adds = F.transform(
        F.sequence(F.col("n"), F.col("n") + horizon - 1),
        lambda t: F.round(F.greatest(F.col("slope") * t + F.col("intercept"), F.lit(floor))
                          .cast("decimal(38,8)"), 2).cast("double"))
    totals = leaky_totals(F.col("_adds"), F.col("last_cumulative_mrr"), horizon, retention)
    rows = (fit.withColumn("_adds", adds).withColumn("_tot", totals)
            .select("last_month", F.posexplode(F.arrays_zip("_adds", "_tot")).alias("k", "z")))
    total = round_money(F.col("z._tot"))
    return rows.select(
        month_label(F.add_months("last_month", F.col("k") + 1)).alias("forecast_month"),
        F.col("z._adds").alias("projected_mrr_added"),
        total.alias("projected_total_mrr"),
        round_money(total * 12.0).alias("projected_total_arr"),
    )


def leaky_totals(adds, start, horizon: int, retention: float = RETENTION_FACTOR):
    """Array of total_k = total_{k-1} * retention + adds[k], total_0 = start,
    for k = 1..horizon: a left fold per prefix (``aggregate`` over ``slice``)."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda k: F.aggregate(F.slice(adds, 1, k), start, lambda acc, a: acc * retention + a))


# ------------------------------------------------------------------ L9
def compound_forecast(c360: DataFrame, ref_date: _dt.date, horizon: int = FORECAST_HORIZON,
                      expansion: float = EXPANSION_RATE, churn: float = COMPOUND_CHURN) -> DataFrame:
    """Notebook forecast: run_m = run + run*expansion - run*churn from the
    current total MRR, labelled '<year after the reference date>-Mmm'."""
    year = (ref_date + _dt.timedelta(days=1)).year
    cur = c360.agg(F.sum(F.col("total_mrr").cast("decimal(38,2)")).cast("double").alias("run0"))
    runs = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda k: F.aggregate(F.sequence(F.lit(1), k), F.col("run0"),
                              lambda acc, _: acc + acc * expansion - acc * churn))
    rows = cur.select(F.posexplode(runs).alias("k", "mrr"))
    return rows.select(
        F.format_string(f"{year}-M%02d", F.col("k") + 1).alias("forecast_month"),
        F.col("mrr").alias("projected_mrr"),
        (F.col("mrr") * 12.0).alias("projected_total_arr"),
    )


# ------------------------------------------------------------------ L10
def ltv_headline(ltv: DataFrame, forecast: DataFrame) -> DataFrame:
    h = ltv.agg(
        F.sum(F.col("total_mrr").cast("decimal(38,2)")).alias("_mrr"),
        round_money(stable_mean("realized_lifetime_value_usd", 2)).alias("avg_realized_ltv"),
        round_money(stable_mean("expected_ltv_usd", 6)).alias("avg_expected_ltv"),
    )
    last = forecast.agg(F.max_by("projected_total_mrr", "forecast_month").alias("projected_12m_exit_mrr"),
                        F.max_by("projected_total_arr", "forecast_month").alias("projected_12m_exit_arr"))
    return h.crossJoin(last).select(
        F.col("_mrr").cast("double").alias("total_active_mrr"),
        (F.col("_mrr") * 12).cast("double").alias("total_active_arr"),
        "avg_realized_ltv", "avg_expected_ltv", "projected_12m_exit_mrr", "projected_12m_exit_arr",
    )


# ------------------------------------------------------------------ L5
def ridge_moments(ltv_c360: DataFrame, features: list[str] = LTV_DRIVER_FEATURES,
                  target: str = "realized_lifetime_value_usd") -> DataFrame:
    """Per feature (NULL -> 0): n, mean and population std -- the scaling
    that standardizes the design -- plus the target's, rounded at 6 dp."""
    names = features + [target]
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names}
    one = ltv_c360.agg(F.count(F.lit(1)).alias("n"), *[e.alias(f"{k}{i}") for i, c in enumerate(names) for k, e in (
        ("m", F.round(stable_mean(x[c], 6), 6)), ("s", F.round(F.stddev_pop(x[c]), 6)))])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col("n"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std_pop"))
        for i, c in enumerate(names)])))


def ridge_drivers(df: DataFrame, features: list[str] = LTV_DRIVER_FEATURES,
                  target: str = "realized_lifetime_value_usd", alpha: float = 1.0) -> DataFrame:
    """Ridge (alpha) on population-standardized features, coefficients sorted
    descending. Spark's normal-equation solver minimises
    1/(2n) |y - Xb|^2 + reg/2 |b|^2 with the label scaled by its population
    std, so reg = alpha * std_pop(y) / n reproduces |y - Xb|^2 + alpha |b|^2."""
    x = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
                  F.col(target).cast("double").alias("_y"))
    x = write_once(x, "ridge")  # the moments, the fit and its summary each read it
    stats = x.agg(*[F.avg(c).alias(f"m_{c}") for c in features],
                  *[F.stddev_pop(c).alias(f"s_{c}") for c in features],
                  F.count(F.lit(1)).alias("_n"), F.stddev_pop("_y").alias("_sy")).first()
    z = x.select(*[((F.col(c) - stats[f"m_{c}"]) /
                    (stats[f"s_{c}"] if stats[f"s_{c}"] else 1.0)).alias(c) for c in features], "_y")
    vec = VectorAssembler(inputCols=features, outputCol="_v").transform(z)
    n, sy = stats["_n"], stats["_sy"] or 0.0
    reg = alpha * sy / n if n else 0.0
    model = LinearRegression(featuresCol="_v", labelCol="_y", solver="normal", regParam=reg,
                             elasticNetParam=0.0, standardization=False, fitIntercept=True).fit(vec)
    spark = df.sparkSession
    coefs = [(f, float(b)) for f, b in zip(features, model.coefficients.toArray())]
    return (spark.createDataFrame(coefs, "feature string, standardized_coefficient double")
            .orderBy(F.desc("standardized_coefficient")))
