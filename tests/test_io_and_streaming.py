"""Sources, sinks, the end-to-end analyses and streaming scoring (sf0.001)."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from retentia.operators import churn as ch
from retentia.operators import features as feat
from retentia.plans import analyses
from retentia.sources import csv as csvsrc
from retentia.sources import sinks
from retentia.sources import tables as src
from retentia.streaming import scoring


@pytest.fixture(scope="module")
def tables(spark, sf_small):
    return src.load_tables(spark, sf_small)


def test_csv_round_trip_gives_same_c360(spark, tables):
    d = tempfile.mkdtemp(prefix="retentia-csv-")
    names = {"dim_accounts": tables.accounts, "fact_subscriptions": tables.subscriptions,
             "fact_feature_usage": tables.usage, "fact_support_tickets": tables.tickets,
             "fact_churn_events": tables.churn}
    for n, df in names.items():
        sinks.write_table(df, os.path.join(d, f"{n}.csv"), "csv")
    back = csvsrc.load_csv_tables(spark, d, src.REFERENCE_DATE)
    a = feat.customer_360(tables).withColumn("account_id", F.col("account_id").cast("string"))
    b = feat.customer_360(back)
    cols = [c for c in a.columns if c not in ("signup_dt", "churn_dt")]
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert b.count() == 150


def test_analyses_write_outputs(spark, tables):
    out = tempfile.mkdtemp(prefix="retentia-out-")
    c360 = analyses.build_customer_360(tables, out)
    s = analyses.run_survival_cohort_analysis(tables, c360, out)
    r = analyses.run_ltv_revenue_forecast(tables, c360, out)
    t = analyses.run_statistical_driver_analysis(tables, c360, out)
    for name in ("customer_360_analytical", "survival_metrics", "ltv_forecast_metrics",
                 "statistical_drivers_summary", "cohort_retention_matrix", "revenue_forecast_12m"):
        assert os.path.isdir(os.path.join(out, name)), name
    rec = spark.read.json(os.path.join(out, "survival_metrics")).first()
    assert rec["total_accounts"] == 150 and rec["churned_accounts"] == 32
    assert 0 <= rec["logrank_enterprise_vs_basic_pvalue"] <= 1
    assert len(rec["top_hazard_factors"]) == 7
    assert r["revenue_forecast_12m"].count() == 12
    assert t["summary"].first()["chisquare_tier_churn"]["dof"] == 2


def test_model_persistence_and_stream_scoring(spark, tables):
    c360 = feat.customer_360(tables)
    exp = ch.ChurnExperiment(c360)
    path = tempfile.mkdtemp(prefix="retentia-model-")
    model = exp.model(ch.MODEL_NAMES[0])
    sinks.save_model(model, path)
    batch = ch.score_with_saved(path, exp.data).select("account_id", "churn_probability")
    # stream: snapshots land as parquet files; the saved model scores them
    src_dir = tempfile.mkdtemp(prefix="retentia-snap-")
    snap = c360.select(*[c for c in c360.columns if c not in ("signup_dt", "churn_dt")])
    snap.write.mode("overwrite").parquet(os.path.join(src_dir, "batch1"))
    schema = spark.read.parquet(os.path.join(src_dir, "batch1")).schema
    sink = tempfile.mkdtemp(prefix="retentia-sink-")
    q = scoring.start_scoring(spark, path, os.path.join(src_dir, "batch1"), schema, sink,
                              checkpoint=tempfile.mkdtemp(prefix="retentia-ck-"))
    q.awaitTermination(120)
    got = spark.read.parquet(sink)
    assert got.count() == 150
    j = got.join(batch, "account_id").where(F.abs(got.churn_probability - batch.churn_probability) > 1e-12)
    assert j.count() == 0


def test_churn_analysis_outputs(spark, tables):
    out = tempfile.mkdtemp(prefix="retentia-churn-")
    c360 = feat.customer_360(tables)
    res = analyses.run_churn_models(c360, out, cross_validate=False)
    comp = res["comparison"].collect()
    assert len(comp) == 3 and sum(r["is_best"] for r in comp) == 1
    assert all(0.0 <= r["roc_auc"] <= 1.0 for r in comp)
    meta = spark.read.json(os.path.join(out, "churn_model_metadata")).first()
    assert meta["best_model"] in ch.MODEL_NAMES
    assert len(meta["top_10_features"]) == 10
    imp = res["feature_importance"].toPandas()
    assert len(meta["all_feature_names"]) == len(imp) > len(ch.NUMERIC_FEATURES)
    assert abs(imp["importance"].sum() - 1.0) < 1e-9
    reloaded = sinks.load_model(os.path.join(out, "churn_model"))
    assert ch.score(reloaded, c360).count() == 150


@pytest.fixture(scope="module")
def raw_csv(tmp_path_factory):
    """Hand-made raw tables: text ids, 2023-24 dates, dotted countries, a missing reason, three-decimal minutes."""
    d = tmp_path_factory.mktemp("raw")
    rows = {"dim_accounts": ["account_id,account_name,industry,country,signup_date,referral_source,plan_tier,seats,is_trial,churn_flag"],
            "fact_subscriptions": ["subscription_id,account_id,start_date,mrr_amount,billing_frequency,upgrade_flag,downgrade_flag,churn_flag"],
            "fact_feature_usage": ["usage_id,subscription_id,feature_name,usage_count,usage_duration_secs,error_count,is_beta_feature"],
            "fact_support_tickets": ["ticket_id,account_id,satisfaction_score,first_response_time_minutes,resolution_time_hours,priority,escalation_flag"],
            "fact_churn_events": ["churn_event_id,account_id,reason_code,refund_amount_usd,is_reactivation,churn_date"]}
    for i in range(60):
        a, churned = f"A-{i:03d}", i % 3 == 0
        rows["dim_accounts"].append(f"{a},N{i},{['Tech', 'Retail'][i % 2]},{['U.S.', 'U.K.', 'DE'][i % 3]},2023-{1 + i % 12:02d}-10,{['ads', 'web'][i // 2 % 2]},"
                                    f"{'' if i == 7 else ['Basic', 'Pro', 'Enterprise'][i % 3 if i % 5 else 0]},{1 + i % 9},{i % 4 == 0},{churned}")
        rows["fact_subscriptions"].append(f"S-{i:03d},{a},2023-{1 + i % 12:02d}-15,{100 + i}.50,{'annual' if i % 2 else 'monthly'},{i % 5 == 0},False,{churned}")
        rows["fact_feature_usage"].append(f"U-{i:03d},S-{i:03d},f{i % 4},{i},{i * 60},{i % 3},{i % 2 == 0}")
        rows["fact_support_tickets"].append(f"T-{i:03d},{a},{1 + (i * 7) % 5},{12.345 + (i * 13) % 17},{2.5 + (i * 5) % 11},{['Urgent', 'High', 'Low', 'Low'][i % 4]},{i % 6 == 0}")
        if churned:
            rows["fact_churn_events"].append(f"C-{i:03d},{a},{['price', 'support', ''][i // 3 % 3]},{10 + i}.25,{i % 2 == 0},2024-{1 + i % 12:02d}-20")
    for n, lines in rows.items():
        (d / f"{n}.csv").write_text("\n".join(lines) + "\n")
    return d


def test_raw_csv_end_to_end(spark, raw_csv, tmp_path):
    import datetime
    t = csvsrc.load_csv_tables(spark, str(raw_csv), datetime.date(2024, 12, 31))
    c360 = analyses.build_customer_360(t, str(tmp_path), "csv")
    by = {r.account_id: r for r in c360.collect()}
    assert len(by) == 60 and by["A-001"].total_mrr == 101.5 and dict(c360.dtypes)["total_mrr"] != "string"
    assert by["A-001"].avg_first_response_min == pytest.approx(12.345 + 13)
    # an active account's tenure runs to the reference date, a churned one's to its churn date
    assert by["A-001"].tenure_months == pytest.approx((datetime.date(2024, 12, 31) - datetime.date(2023, 2, 10)).days / 30.44, abs=0.06)
    assert by["A-003"].tenure_months == pytest.approx((datetime.date(2024, 4, 20) - datetime.date(2023, 4, 10)).days / 30.44, abs=0.06)
    s = analyses.run_survival_cohort_analysis(t, c360, str(tmp_path))
    assert {r.plan_tier for r in s["km_by_tier"].collect()} == {"Basic", "Pro", "Enterprise"}
    d = analyses.run_statistical_driver_analysis(t, c360, str(tmp_path))
    assert {r.reason_code: r["count"] for r in d["refund_stats"].collect()} == {"price": 7, "support": 7}
    assert d["ols_diagnostics"].first().durbin_watson > 0
    r = analyses.run_ltv_revenue_forecast(t, c360, str(tmp_path))
    assert {x.plan_tier: x.account_count for x in r["ltv_by_tier"].collect()}["Enterprise"] == sum(i % 3 == 2 and i % 5 != 0 for i in range(60))
    exp = ch.ChurnExperiment(c360)
    assert "country_U.S." in exp.encoding.feature_names
    assert exp.test_scores(ch.MODEL_NAMES[0]).count() > 0


def test_csv_without_a_declared_column_is_an_error(spark, raw_csv, tmp_path):
    import datetime
    import shutil
    shutil.copytree(raw_csv, tmp_path / "raw")
    p = tmp_path / "raw" / "fact_subscriptions.csv"
    p.write_text(p.read_text().replace("mrr_amount", "mrr"))
    with pytest.raises(ValueError, match="mrr_amount"):
        csvsrc.load_csv_tables(spark, str(tmp_path / "raw"), datetime.date(2024, 12, 31))
    with pytest.raises(TypeError):
        csvsrc.load_csv_tables(spark, str(raw_csv))


def test_two_thousand_levels(spark):
    df = spark.createDataFrame([(i, float(i % 7), f"level {i % 2000}") for i in range(4000)], "k int, x double, c string")
    enc = ch.Encoding(df, ["x"], ["c"])
    assert len(enc.levels["c"]) == 2000 and len(enc.dummy_names) == 1999


def test_sizing():
    from retentia.session import sizing
    conf = sizing(100 * 1024 ** 4)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
