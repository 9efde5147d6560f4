"""The five analyses end to end, as the reference runs them, on Spark.

Each function takes the subscription tables (``sources.tables.load_tables``
or ``sources.csv.load_csv_tables``), builds its result DataFrames and, when
``out_dir`` is given, writes them with the Spark writers: tables as Parquet
or CSV, summaries as one-row JSON records, the churn model as a saved
``PipelineModel``. The Customer-360 matrix is materialised once as Parquet
and read back by the other analyses (the reference passes it on as a CSV).

Command line:
    python -m retentia.plans.analyses --sf-dir /root/testdata/sf0.01 --out /path/to/out
"""

from __future__ import annotations

import argparse
import datetime
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import churn as ch
from ..operators import cohort as coh
from ..operators import features as feat
from ..operators import revenue as rev
from ..operators import stats as st
from ..operators import survival as surv
from ..sources import sinks
from ..sources import tables as src


def _out(out_dir: str | None, name: str) -> str | None:
    return os.path.join(out_dir, name) if out_dir else None


def build_customer_360(tables, out_dir: str | None = None, fmt: str = "parquet") -> DataFrame:
    """The 49-column matrix; written once so later analyses read it."""
    c360 = feat.customer_360(tables)
    path = _out(out_dir, "customer_360_analytical")
    if path:
        sinks.write_table(c360, path, fmt)
        # CSV has no types of its own: read it back with the matrix's schema
        return c360.sparkSession.read.schema(c360.schema).format(fmt).option("header", True).load(path)
    return c360


def run_survival_cohort_analysis(tables, c360: DataFrame, out_dir: str | None = None) -> dict:
    """Kaplan-Meier (overall, by tier, band), log-rank Enterprise vs Basic,
    Cox hazard ratios, cohort retention matrix and the summary record."""
    km_all = surv.kaplan_meier(c360, "tenure_months", "churn_flag")
    km_tier = surv.kaplan_meier_confidence(c360, "tenure_months", "churn_flag", ["plan_tier"])
    lr = surv.logrank_test(c360, "tenure_months", "churn_flag", "plan_tier", "Enterprise", "Basic")
    cox = surv.cox_hazard_table(c360)
    long = coh.cohort_retention(tables.subscriptions, tables.accounts)
    top = long.agg(F.max("cohort_index")).first()[0]
    matrix = coh.cohort_matrix(long, list(range(0, int(top) + 1)) if top is not None else [])
    head = surv.survival_headline(c360)
    summary = head.crossJoin(
        cox.agg(F.collect_list(F.struct(*cox.columns)).alias("top_hazard_factors"))
    ).withColumn("logrank_enterprise_vs_basic_pvalue", F.round(F.lit(lr["p_value"]), 4))
    res = {"km_overall": km_all, "km_by_tier": km_tier, "cox_hazard_ratios": cox,
           "cohort_retention_long": long, "cohort_retention_matrix": matrix, "summary": summary}
    if out_dir:
        for k in ("km_overall", "km_by_tier", "cohort_retention_long"):
            sinks.write_table(res[k], _out(out_dir, k))
        sinks.write_table(cox, _out(out_dir, "cox_hazard_ratios"), "csv")
        sinks.write_table(matrix, _out(out_dir, "cohort_retention_matrix"), "csv")
        sinks.write_record(summary, _out(out_dir, "survival_metrics"))
    return res


def run_ltv_revenue_forecast(tables, c360: DataFrame, out_dir: str | None = None) -> dict:
    """LTV per account and tier, ridge drivers, monthly MRR, forecast and
    the summary record."""
    ltv = rev.ltv_accounts(c360)
    tier = rev.ltv_by_tier(ltv)
    drivers = rev.ridge_drivers(c360.withColumn("realized_lifetime_value_usd", F.col("total_mrr")))
    mrr = rev.monthly_mrr(tables.subscriptions)
    forecast = rev.trend_forecast(rev.trend_fit(mrr))
    summary = rev.ltv_headline(ltv, forecast).crossJoin(
        drivers.agg(F.collect_list(F.struct("feature", "standardized_coefficient")).alias("ltv_drivers")))
    res = {"ltv_by_tier": tier, "ltv_drivers": drivers, "monthly_mrr": mrr,
           "revenue_forecast_12m": forecast, "summary": summary}
    if out_dir:
        sinks.write_table(tier, _out(out_dir, "ltv_by_tier_summary"), "csv")
        sinks.write_table(forecast, _out(out_dir, "revenue_forecast_12m"), "csv")
        sinks.write_table(mrr, _out(out_dir, "monthly_mrr"))
        sinks.write_record(summary, _out(out_dir, "ltv_forecast_metrics"))
    return res


def run_statistical_driver_analysis(tables, c360: DataFrame, out_dir: str | None = None) -> dict:
    """P5: OLS of CSAT (coefficients, fit, diagnostics), ANOVA of refunds by
    reason, chi-square tier x churn, correlation matrix, summary record."""
    spark = c360.sparkSession
    ols = st.OLSResult(st.ticket_design(tables.tickets), "satisfaction_score", st.TICKET_REGRESSORS,
                       order_by="ticket_id")
    coefs, fit, diag = ols.coefficients(), ols.fit(), ols.diagnostics()
    an = st.anova_test(tables.churn, "refund_amount_usd", "reason_code")
    chi = st.chi_square_test(c360, "plan_tier", "churn_flag")
    corr = st.correlation(c360, st.CORR_COLUMNS)
    summary = fit.select(F.struct(
        F.round("r_squared", 4).alias("r_squared"), F.round("r_squared_adj", 4).alias("r_squared_adj"),
        F.round("f_statistic", 4).alias("f_statistic"), F.col("f_pvalue"),
        F.col("significant_features")).alias("ols_csat_model")).crossJoin(spark.createDataFrame(
            [((round(an["f_statistic"], 4), round(an["p_value"], 4), an["statistically_significant"]),
              (round(chi["chi2_statistic"], 4), round(chi["p_value"], 4), int(chi["dof"]),
               chi["statistically_significant"]))],
            "anova_churn_refunds struct<f_statistic:double,p_value:double,statistically_significant:boolean>,"
            " chisquare_tier_churn struct<chi2_statistic:double,p_value:double,dof:int,"
            "statistically_significant:boolean>"))
    res = {"ols_coefficients": coefs, "ols_fit": fit, "ols_diagnostics": diag,
           "refund_stats": st.group_summary(tables.churn, "refund_amount_usd", "reason_code"),
           "correlation_matrix": corr, "summary": summary}
    if out_dir:
        sinks.write_table(coefs, _out(out_dir, "ols_csat_coefficients"), "csv")
        sinks.write_table(fit.drop("significant_features"), _out(out_dir, "ols_csat_fit"), "csv")
        sinks.write_table(diag, _out(out_dir, "ols_csat_diagnostics"), "csv")
        sinks.write_table(corr, _out(out_dir, "correlation_matrix"), "csv")
        sinks.write_record(summary, _out(out_dir, "statistical_drivers_summary"))
    return res


def run_churn_models(c360: DataFrame, out_dir: str | None = None, cross_validate: bool = True) -> dict:
    """Split, cross-validate and fit three models, compare on the hold-out,
    forest importances, persist the best model, metadata record."""
    exp = ch.ChurnExperiment(c360)
    comp = exp.comparison()
    best = comp.where("is_best").select("model", "roc_auc").first()
    imp = exp.feature_importance()
    res = {"comparison": comp, "feature_importance": imp}
    if cross_validate:
        res["cv"] = exp.cross_validate()
    spark = c360.sparkSession
    meta = spark.createDataFrame(
        [(best["model"], float(best["roc_auc"]), ch.NUMERIC_FEATURES, ch.CATEGORICAL_FEATURES,
          exp.encoding.feature_names)],
        "best_model string, best_roc_auc double, numeric_features array<string>, "
        "categorical_features array<string>, all_feature_names array<string>")
    meta = (meta.crossJoin(comp.agg(F.collect_list(F.struct(*comp.columns)).alias("test_metrics")))
            .crossJoin(imp.limit(10).agg(F.collect_list(F.struct("feature", "importance"))
                                         .alias("top_10_features"))))
    res["metadata"] = meta
    if out_dir:
        exp.save_best(_out(out_dir, "churn_model"))
        sinks.write_table(imp, _out(out_dir, "churn_feature_importance"), "csv")
        sinks.write_record(meta, _out(out_dir, "churn_model_metadata"))
    return res


def run_all(spark: SparkSession, tables, out_dir: str, cross_validate: bool = True) -> None:
    c360 = build_customer_360(tables, out_dir)
    run_churn_models(c360, out_dir, cross_validate)
    run_survival_cohort_analysis(tables, c360, out_dir)
    run_ltv_revenue_forecast(tables, c360, out_dir)
    run_statistical_driver_analysis(tables, c360, out_dir)


def main(argv=None) -> None:
    from ..session import build_session
    from ..sources.csv import load_csv_tables
    ap = argparse.ArgumentParser(description="Run the five subscription analyses.")
    ap.add_argument("--sf-dir", help="driver parquet tables (TPC-H style)")
    ap.add_argument("--csv-dir", help="raw subscription CSV tables")
    ap.add_argument("--reference-date", type=datetime.date.fromisoformat,
                    help="end of observation, YYYY-MM-DD (with --csv-dir)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--master", default=None)
    ap.add_argument("--no-cv", action="store_true")
    a = ap.parse_args(argv)
    if a.csv_dir and not a.reference_date:
        ap.error("--csv-dir needs --reference-date")
    spark = build_session(a.master)
    tables = load_csv_tables(spark, a.csv_dir, a.reference_date) if a.csv_dir else src.load_tables(spark, a.sf_dir)
    run_all(spark, tables, a.out, cross_validate=not a.no_cv)


if __name__ == "__main__":
    main()
