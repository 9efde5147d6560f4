"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables through ``sources.tables`` and runs over
the whole tables. The DuckDB oracle for each key lives in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import churn as ch
from ..operators import cohort as coh
from ..operators import features as feat
from ..operators import metrics as met
from ..operators import revenue as rev
from ..operators import stats as st
from ..operators import survival as surv
from ..session import write_once
from ..sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def c360(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.customer_360(src.load_tables(spark, sf_dir))


def c360_written(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns that a query reads in several branches, selected first and
    then written once: the fact tables behind other columns are not scanned."""
    return write_once(c360(spark, sf_dir).select(*columns), "c360")


# ----------------------------------------------------------------- sources
@query("table_row_counts")
def table_row_counts(spark, sf_dir):
    t = src.load_tables(spark, sf_dir)
    parts = [("accounts", t.accounts), ("subscriptions", t.subscriptions),
             ("feature_usage", t.usage), ("support_tickets", t.tickets),
             ("churn_events", t.churn)]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


# ----------------------------------------------------------------- features
@query("c360_subscriptions")
def c360_subscriptions(spark, sf_dir):
    return feat.subscription_features(src.subscriptions(spark, sf_dir))


@query("usage_with_account")
def usage_with_account(spark, sf_dir):
    return feat.usage_with_account(src.feature_usage(spark, sf_dir), src.subscriptions(spark, sf_dir))


@query("c360_usage")
def c360_usage(spark, sf_dir):
    return feat.usage_features(src.feature_usage(spark, sf_dir), src.subscriptions(spark, sf_dir))


@query("c360_tickets")
def c360_tickets(spark, sf_dir):
    return feat.ticket_features(src.support_tickets(spark, sf_dir))


@query("c360_churn")
def c360_churn(spark, sf_dir):
    return feat.churn_features(src.churn_events(spark, sf_dir))


@query("c360_master")
def c360_master(spark, sf_dir):
    return c360(spark, sf_dir)


@query("tenure")
def tenure(spark, sf_dir):
    return feat.tenure(c360(spark, sf_dir))


@query("top_accounts_by_mrr")
def top_accounts_by_mrr(spark, sf_dir):
    """Top-10 accounts by total MRR (the limit is the feature: a top-k report)."""
    return (c360(spark, sf_dir)
            .select("account_id", "account_name", "industry", "plan_tier", "seats", "total_mrr",
                    "error_rate_per_100_events", "avg_csat", "churn_flag")
            .orderBy(F.desc("total_mrr"), "account_id").limit(10))


@query("c360_variant_b")
def c360_variant_b(spark, sf_dir):
    return feat.customer_360_variant_b(src.load_tables(spark, sf_dir))


# ----------------------------------------------------------------- cohort


@query("cohort_retention_long")
def cohort_retention_long(spark, sf_dir):
    return coh.cohort_retention(src.subscriptions(spark, sf_dir), src.accounts(spark, sf_dir))


@query("cohort_retention_matrix")
def cohort_retention_matrix(spark, sf_dir):
    long = cohort_retention_long(spark, sf_dir)
    # a column for every month of the tables' calendar (1992-01 to 1998-08),
    # and for later indices if there are any: no cell is dropped
    top = long.agg(F.max("cohort_index")).first()[0]
    return coh.cohort_matrix(long, list(range(max(79, int(top or 0)) + 1)))


@query("cohort_retention_active")
def cohort_retention_active(spark, sf_dir):
    return coh.cohort_retention_active(src.subscriptions(spark, sf_dir), src.accounts(spark, sf_dir), 12, 12)


# ----------------------------------------------------------------- revenue


def _ltv(spark, sf_dir):
    return rev.ltv_accounts(c360(spark, sf_dir))


def _forecast(spark, sf_dir):
    return rev.trend_forecast(rev.trend_fit(rev.monthly_mrr(src.subscriptions(spark, sf_dir))))


@query("monthly_mrr")
def monthly_mrr(spark, sf_dir):
    return rev.monthly_mrr(src.subscriptions(spark, sf_dir))


@query("mrr_trend_fit")
def mrr_trend_fit(spark, sf_dir):
    return rev.trend_fit(rev.monthly_mrr(src.subscriptions(spark, sf_dir)))


@query("revenue_forecast_12m")
def revenue_forecast_12m(spark, sf_dir):
    return _forecast(spark, sf_dir)


@query("revenue_forecast_compound")
def revenue_forecast_compound(spark, sf_dir):
    return rev.compound_forecast(c360(spark, sf_dir), src.REFERENCE_DATE)


@query("ltv_account")
def ltv_account(spark, sf_dir):
    return _ltv(spark, sf_dir)


@query("ltv_by_tier")
def ltv_by_tier(spark, sf_dir):
    return rev.ltv_by_tier(rev.ltv_accounts(c360_written(
        spark, sf_dir, "account_id", "plan_tier", "churn_flag", "tenure_months", "total_mrr")))


@query("ltv_by_tier_variant_b")
def ltv_by_tier_variant_b(spark, sf_dir):
    return rev.ltv_by_tier_variant_b(feat.customer_360_variant_b(src.load_tables(spark, sf_dir)))


@query("ltv_headline")
def ltv_headline(spark, sf_dir):
    return rev.ltv_headline(_ltv(spark, sf_dir), _forecast(spark, sf_dir))


@query("ltv_ridge_moments")
def ltv_ridge_moments(spark, sf_dir):
    return rev.ridge_moments(_ltv_features(spark, sf_dir))


def _ltv_features(spark, sf_dir):
    return c360(spark, sf_dir).withColumn("realized_lifetime_value_usd", F.col("total_mrr"))


@query("ltv_ridge_drivers")
def ltv_ridge_drivers(spark, sf_dir):
    return rev.ridge_drivers(_ltv_features(spark, sf_dir))


# ----------------------------------------------------------------- survival


@query("km_overall")
def km_overall(spark, sf_dir):
    return surv.kaplan_meier(c360(spark, sf_dir), "tenure_months", "churn_flag")


@query("km_by_tier")
def km_by_tier(spark, sf_dir):
    return surv.kaplan_meier(c360(spark, sf_dir), "tenure_months", "churn_flag", ["plan_tier"])


@query("km_confidence")
def km_confidence(spark, sf_dir):
    return surv.kaplan_meier_confidence(c360(spark, sf_dir), "tenure_months", "churn_flag",
                                        ["plan_tier"])


@query("logrank_tier")
def logrank_tier(spark, sf_dir):
    return surv.logrank(c360(spark, sf_dir), "tenure_months", "churn_flag", "plan_tier",
                        "Enterprise", "Basic")


@query("survival_naive_by_tier")
def survival_naive_by_tier(spark, sf_dir):
    return surv.naive_survival(feat.customer_360_variant_b(src.load_tables(spark, sf_dir)),
                               "tenure_months", "churn_flag", ["plan_tier"])


@query("survival_headline")
def survival_headline(spark, sf_dir):
    return surv.survival_headline(c360_written(spark, sf_dir, "tenure_months", "churn_flag"))


@query("cox_risk_sets")
def cox_risk_sets(spark, sf_dir):
    return surv.cox_risk_sets(c360(spark, sf_dir), "tenure_months", "churn_flag", surv.COX_COVARIATES)


@query("cox_hazard_ratios")
def cox_hazard_ratios(spark, sf_dir):
    return surv.cox_hazard_table(c360(spark, sf_dir))


# ----------------------------------------------------------------- statistics


@query("anova_refund_by_reason")
def anova_refund_by_reason(spark, sf_dir):
    return st.anova(src.churn_events(spark, sf_dir), "refund_amount_usd", "reason_code")


@query("refund_stats_by_reason")
def refund_stats_by_reason(spark, sf_dir):
    return st.group_summary(src.churn_events(spark, sf_dir), "refund_amount_usd", "reason_code")


@query("tier_churn_crosstab")
def tier_churn_crosstab(spark, sf_dir):
    return st.crosstab(c360(spark, sf_dir), "plan_tier", "churn_flag", [0, 1])


@query("chisq_tier_churn")
def chisq_tier_churn(spark, sf_dir):
    return st.chi_square(c360(spark, sf_dir), "plan_tier", "churn_flag")


@query("correlation_matrix")
def correlation_matrix(spark, sf_dir):
    return st.correlation(c360(spark, sf_dir), st.CORR_COLUMNS)


@query("correlation_matrix_variant_b")
def correlation_matrix_variant_b(spark, sf_dir):
    return st.correlation(feat.customer_360_variant_b(src.load_tables(spark, sf_dir)), st.CORR_COLUMNS_B)


def _ticket_ols(spark, sf_dir):
    return st.OLSResult(st.ticket_design(src.support_tickets(spark, sf_dir)), "satisfaction_score",
                        st.TICKET_REGRESSORS, order_by="ticket_id")


@query("ols_csat_gram")
def ols_csat_gram(spark, sf_dir):
    return st.gram(st.ticket_design(src.support_tickets(spark, sf_dir)), "satisfaction_score",
                   st.TICKET_REGRESSORS)


@query("ols_csat_coefficients")
def ols_csat_coefficients(spark, sf_dir):
    return _ticket_ols(spark, sf_dir).coefficients()


@query("ols_csat_fit")
def ols_csat_fit(spark, sf_dir):
    return _ticket_ols(spark, sf_dir).fit()


@query("ols_csat_diagnostics")
def ols_csat_diagnostics(spark, sf_dir):
    return _ticket_ols(spark, sf_dir).diagnostics()


@query("ols_account_csat")
def ols_account_csat(spark, sf_dir):
    b = feat.customer_360_variant_b(src.load_tables(spark, sf_dir))
    return st.OLSResult(b, "avg_csat", st.ACCOUNT_CSAT_REGRESSORS).coefficients()


@query("ols_account_csat_fit")
def ols_account_csat_fit(spark, sf_dir):
    b = feat.customer_360_variant_b(src.load_tables(spark, sf_dir))
    return st.OLSResult(b, "avg_csat", st.ACCOUNT_CSAT_REGRESSORS).fit()


# ----------------------------------------------------------------- churn


@query("churn_class_balance")
def churn_class_balance(spark, sf_dir):
    g = c360(spark, sf_dir).groupBy("churn_flag").agg(F.count(F.lit(1)).alias("count"))
    # two rows: the window over all groups is over the aggregated table
    return g.withColumn("share", F.col("count").cast("double")
                        / F.sum("count").over(Window.partitionBy()).cast("double"))


@query("stratified_split")
def stratified_split(spark, sf_dir):
    return ch.stratified_split(c360_written(spark, sf_dir, "account_id", "churn_flag")).select("account_id", "churn_flag", "is_test",
                                                           "train_rank")


@query("stratified_folds")
def stratified_folds(spark, sf_dir):
    return ch.stratified_folds(ch.stratified_split(c360_written(spark, sf_dir, "account_id", "churn_flag"))).select(
        "account_id", "churn_flag", "train_rank", "fold")


def _long(df, names_exprs, digits=None):
    cells = [F.struct(F.lit(n).alias("feature"),
                      (F.round(e, digits) if digits is not None else e).alias("value"))
             for n, e in names_exprs]
    return df.select("account_id", F.explode(F.array(*cells)).alias("e")).select("account_id", "e.*")


def _churn_inputs(spark, sf_dir):
    """The matrix's model columns, written once: the split reads them twice."""
    return c360_written(spark, sf_dir, "account_id", "churn_flag", *ch.NUMERIC_FEATURES, *ch.CATEGORICAL_FEATURES)


@query("standardized_features")
def standardized_features(spark, sf_dir):
    data = write_once(ch.stratified_split(_churn_inputs(spark, sf_dir)), "split")
    enc = ch.Encoding(data.where(~F.col("is_test")))
    scaled = enc.transformer().transform(data)
    return _long(scaled, [(c, F.col(n)) for c, n in zip(enc.numeric, enc.input_columns())], digits=6)


@query("onehot_features")
def onehot_features(spark, sf_dir):
    data = write_once(ch.stratified_split(_churn_inputs(spark, sf_dir)), "split")
    enc = ch.Encoding(data.where(~F.col("is_test")))
    coded = enc.transformer().transform(data)
    return _long(coded, [(n, F.col(c).cast("int"))
                         for n, c in zip(enc.dummy_names, enc.input_columns()[len(enc.numeric):])])


@query("binary_metrics")
def binary_metrics(spark, sf_dir):
    return met.binary_metrics(met.rule_score(c360(spark, sf_dir)), "churn_flag", "score")


@query("confusion_matrix")
def confusion_matrix(spark, sf_dir):
    return met.confusion_matrix(met.rule_score(c360(spark, sf_dir)), "churn_flag", "score")


def _experiment(spark, sf_dir):
    return ch.ChurnExperiment(_churn_inputs(spark, sf_dir))


@query("churn_logistic")
def churn_logistic(spark, sf_dir):
    return _experiment(spark, sf_dir).evaluate(ch.MODEL_NAMES[0])


@query("churn_random_forest")
def churn_random_forest(spark, sf_dir):
    return _experiment(spark, sf_dir).evaluate(ch.MODEL_NAMES[1])


@query("churn_gbt")
def churn_gbt(spark, sf_dir):
    return _experiment(spark, sf_dir).evaluate(ch.MODEL_NAMES[2])


@query("churn_model_comparison")
def churn_model_comparison(spark, sf_dir):
    return _experiment(spark, sf_dir).comparison()


@query("churn_cv_auc")
def churn_cv_auc(spark, sf_dir):
    return _experiment(spark, sf_dir).cross_validate()


@query("churn_feature_importance")
def churn_feature_importance(spark, sf_dir):
    return _experiment(spark, sf_dir).feature_importance()


@query("boosting_root_histogram")
def boosting_root_histogram(spark, sf_dir):
    """Gradient and Hessian sums of every bin before the first boosted tree (fixed-point), of the script's training rows."""
    exp = _experiment(spark, sf_dir)
    table, cuts = exp._tree_table(exp.train)
    names = spark.createDataFrame(list(enumerate(exp.encoding.feature_names)), "input int, feature string")
    par = ch.boosting_settings("a", exp.pos_weight_gbt)
    return ch.tr.gradient_histogram(table, cuts, par).join(F.broadcast(names.withColumnRenamed("input", "_i")), F.col("input") == F.col("_i")).select(
        "feature", "code", "gradient", "hessian")


@query("churn_score_accounts")
def churn_score_accounts(spark, sf_dir):
    exp = _experiment(spark, sf_dir)
    path = ch.model_path(spark)
    best = exp.save_best(path)
    scored = ch.score_with_saved(path, exp.data)
    return scored.select("account_id", F.lit(best).alias("model"), "churn_probability",
                         "churn_prediction")


def _experiment_b(spark, sf_dir):
    return ch.ChurnExperiment(feat.customer_360_variant_b(src.load_tables(spark, sf_dir)), variant="b")


@query("churn_model_comparison_variant_b")
def churn_model_comparison_variant_b(spark, sf_dir):
    """Notebook benchmark table: AUC and PR-AUC at 4 decimals, accuracy as a
    percentage string, best AUC first."""
    comp = _experiment_b(spark, sf_dir).comparison()
    return comp.select(
        "model", F.round("roc_auc", 4).alias("test_roc_auc"), F.round("pr_auc", 4).alias("pr_auc"),
        F.concat(F.round(F.col("accuracy") * 100.0, 1).cast("decimal(10,1)").cast("string"), F.lit("%"))
        .alias("accuracy"), "rank").orderBy("rank")


@query("churn_feature_importance_variant_b")
def churn_feature_importance_variant_b(spark, sf_dir):
    """Top-12 forest importances of the notebook model (the limit is the report)."""
    return _experiment_b(spark, sf_dir).feature_importance().limit(12)
