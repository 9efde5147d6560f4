"""Spark operators against NumPy brute force on sf0.001-derived fixtures."""
import math

import numpy as np
import pandas as pd
import pytest
from decimal import Decimal
from pyspark.sql import Window
from pyspark.sql import functions as F

from retentia.operators import churn as ch
from retentia.operators import features as feat
from retentia.operators import ordered
from retentia.operators import revenue as rev
from retentia.operators import stats as st
from retentia.operators import survival as surv
from retentia.operators.quantiles import exact_median
from retentia.sources import tables as src


@pytest.fixture(scope="module")
def c360(spark, sf_small):
    return feat.customer_360(src.load_tables(spark, sf_small)).cache()


@pytest.fixture(scope="module")
def c360_pd(c360):
    return c360.toPandas()


@pytest.fixture
def small_ranges(monkeypatch):
    """Ranges of seven rows, so that the stitching of ranges is tested."""
    monkeypatch.setattr(ordered, "range_count", lambda rows, per=0: max(1, -(-rows // 7)))


def test_exact_median_matches_numpy(spark, small_ranges):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=501), np.zeros(300), rng.integers(0, 3, size=100)])
    groups = rng.integers(0, 4, size=len(vals))
    pdf = pd.DataFrame({"g": groups.astype(int), "x": vals})
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r["median"] for r in exact_median(df, "x", ["g"]).collect()}
    for g, sub in pdf.groupby("g"):
        assert got[g] == float(np.median(sub["x"]))
    assert exact_median(df, "x").first()["median"] == float(np.median(vals))
    # tiny sketch accuracy forces the fallback path for some groups
    got2 = {r["g"]: r["median"] for r in exact_median(df, "x", ["g"]).collect()}
    assert got2 == got


def test_hash_ranks_equal_global_row_number(c360):
    r = ch.hash_ranks(c360.select("account_id", "churn_flag"), ["churn_flag"], "account_id")
    w = Window.partitionBy("churn_flag").orderBy(
        F.md5(F.concat(F.col("account_id").cast("string"), F.lit("-42"))), "account_id")
    ref = c360.select("account_id", F.row_number().over(w).alias("rn"))
    j = r.join(ref, "account_id")
    assert j.where(F.col("_rank") != F.col("rn")).count() == 0
    assert j.count() == c360.count()


def test_split_sizes_and_folds(c360_pd, c360):
    s = ch.stratified_split(c360).toPandas()
    for flag, sub in s.groupby("churn_flag"):
        n = len(sub)
        assert sub["is_test"].sum() == int(np.floor(0.2 * n + 0.5))
    f = ch.stratified_folds(ch.stratified_split(c360)).toPandas()
    counts = f.groupby(["churn_flag", "fold"]).size().unstack()
    assert (counts.max(axis=1) - counts.min(axis=1) <= 1).all()


def test_running_sums_and_successive_diffs(spark, small_ranges):
    rng = np.random.default_rng(3)
    x = rng.permutation(2000).astype(float)
    v = rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"k": x, "v": v}))
    got = ordered.running_sums(df, "k", ["v"], buckets=16).toPandas().sort_values("k")
    order = np.argsort(x)
    assert np.allclose(got["cum_v"].to_numpy(), np.cumsum(v[order]))
    dw = ordered.successive_diff_sq_sum(df, "k", "v")
    assert dw == pytest.approx(float(np.sum(np.diff(v[order]) ** 2)), rel=1e-12)


def test_ols_matches_lstsq(spark, sf_small):
    d = st.ticket_design(src.support_tickets(spark, sf_small))
    res = st.OLSResult(d, "satisfaction_score", st.TICKET_REGRESSORS)
    pdf = d.toPandas()
    X = np.column_stack([np.ones(len(pdf))] + [pdf[c].to_numpy(float) for c in st.TICKET_REGRESSORS])
    y = pdf["satisfaction_score"].to_numpy(float)
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    got = res.coefficients().toPandas().set_index("term")["coef"]
    assert np.allclose(got.to_numpy(), beta, rtol=1e-8, atol=1e-10)
    resid = y - X @ beta
    sigma2 = resid @ resid / (len(y) - X.shape[1])
    se = np.sqrt(np.diag(sigma2 * np.linalg.inv(X.T @ X)))
    assert np.allclose(res.coefficients().toPandas()["std_err"].to_numpy(), se, rtol=1e-6)
    fit = res.fit().first()
    r2 = 1 - resid @ resid / np.sum((y - y.mean()) ** 2)
    assert fit["r_squared"] == pytest.approx(r2, rel=1e-8)


def test_ridge_matches_closed_form(c360, c360_pd):
    feats = rev.LTV_DRIVER_FEATURES
    df = c360.withColumn("realized_lifetime_value_usd", F.col("total_mrr"))
    got = rev.ridge_drivers(df).toPandas().set_index("feature")["standardized_coefficient"]
    X = c360_pd[feats].fillna(0).to_numpy(float)
    sd = X.std(axis=0)
    sd[sd == 0] = 1.0
    Z = (X - X.mean(axis=0)) / sd
    y = c360_pd["total_mrr"].to_numpy(float)
    yc = y - y.mean()
    beta = np.linalg.solve(Z.T @ Z + 1.0 * np.eye(Z.shape[1]), Z.T @ yc)
    assert np.allclose(got[feats].to_numpy(), beta, rtol=1e-5, atol=1e-6 * np.abs(beta).max())


def _efron_numpy(T, E, X, iters=30):
    n, p = X.shape
    Xs = (X - X.mean(0)) / np.where(X.std(0, ddof=1) > 0, X.std(0, ddof=1), 1)
    beta = np.zeros(p)
    for _ in range(iters):
        w = np.exp(Xs @ beta)
        grad, hess = np.zeros(p), np.zeros((p, p))
        for t in np.unique(T[E == 1]):
            risk = T >= t
            dead = (T == t) & (E == 1)
            d = dead.sum()
            s0, s1 = w[risk].sum(), (w[risk, None] * Xs[risk]).sum(0)
            s2 = (w[risk, None, None] * Xs[risk, :, None] * Xs[risk, None, :]).sum(0)
            t0, t1 = w[dead].sum(), (w[dead, None] * Xs[dead]).sum(0)
            t2 = (w[dead, None, None] * Xs[dead, :, None] * Xs[dead, None, :]).sum(0)
            grad += Xs[dead].sum(0)
            for l in range(d):
                f = l / d
                a0, a1, a2 = s0 - f * t0, s1 - f * t1, s2 - f * t2
                grad -= a1 / a0
                hess += a2 / a0 - np.outer(a1, a1) / a0 ** 2
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    sd = np.where(X.std(0, ddof=1) > 0, X.std(0, ddof=1), 1)
    return beta / sd, np.sqrt(np.diag(np.linalg.inv(hess))) / sd


def test_cox_matches_numpy_efron(c360, c360_pd):
    cov = surv.COX_COVARIATES
    table, info = surv.cox_ph(c360, "tenure_months", "churn_flag", cov)
    got = table.toPandas().set_index("covariate")
    d = c360_pd[["tenure_months", "churn_flag"] + cov].dropna()
    b, se = _efron_numpy(d["tenure_months"].to_numpy(float), d["churn_flag"].to_numpy(int),
                         d[cov].to_numpy(float))
    assert np.allclose(got.loc[cov, "coef"].to_numpy(), b, rtol=1e-6, atol=1e-9)
    assert np.allclose(got.loc[cov, "se_coef"].to_numpy(), se, rtol=1e-5)


def test_kaplan_meier_matches_numpy(c360, c360_pd):
    km = surv.kaplan_meier(c360, "tenure_months", "churn_flag", digits=12).toPandas().sort_values("t")
    T, E = c360_pd["tenure_months"].to_numpy(float), c360_pd["churn_flag"].to_numpy(int)
    s, out = 1.0, {}
    for t in np.unique(T):
        n, d = (T >= t).sum(), ((T == t) & (E == 1)).sum()
        s *= 1 - d / n
        out[t] = s
    for _, r in km.iterrows():
        if r["t"] in out:
            assert r["survival"] == pytest.approx(out[r["t"]], abs=1e-12)


def test_logrank_p_value(c360, c360_pd):
    r = surv.logrank_test(c360, "tenure_months", "churn_flag", "plan_tier", "Enterprise", "Basic")
    two = c360_pd[c360_pd["plan_tier"].isin(["Enterprise", "Basic"])]
    T, E = two["tenure_months"].to_numpy(float), two["churn_flag"].to_numpy(int)
    A = (two["plan_tier"] == "Enterprise").to_numpy()
    diff = var = 0.0
    for t in np.unique(T[E == 1]):
        n, na, d = (T >= t).sum(), ((T >= t) & A).sum(), ((T == t) & (E == 1)).sum()
        diff += ((T == t) & (E == 1) & A).sum() - d * na / n
        var += d * (na / n) * (1 - na / n) * (n - d) / (n - 1) if n > 1 else 0.0
    assert r["test_statistic"] == pytest.approx(diff ** 2 / var, rel=1e-9)
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(diff ** 2 / var / 2)), rel=1e-9)


def test_efron_terms_with_very_many_ties(spark):
    """More than 100,000 events at one time, risk sets up to 1e10 (sums given)."""
    rng = np.random.default_rng(3)
    rows, expected = [], np.zeros(1 + 2 + 3)
    for s0, share, d in ((1e9, 2e-4, 200_000), (1e10, 2e-5, 150_001), (5e6, 0.05, 70_000), (80.0, 1.0, 120), (50.0, 0.02, 1)):
        s1, s2 = s0 * rng.normal(0, 0.1, 2), s0 * np.array([1.0, 0.1, 1.2])
        t0, t1, t2 = share * s0, share * s1 * 0.9, share * s2 * 0.95
        rows.append((d, s0, *s1, *s2, t0, *t1, *t2))
        c = np.arange(d) / d
        a0 = s0 - c * t0
        a1 = [(s1[i] - c * t1[i]) / a0 for i in range(2)]
        a2 = [(s2[k] - c * t2[k]) / a0 for k in range(3)]
        expected += np.array([np.log(a0).sum(), *[a.sum() for a in a1],
                              *[(a2[k] - a1[i] * a1[j]).sum() for k, (i, j) in enumerate([(0, 0), (0, 1), (1, 1)])]])
    names = ["0", "1_0", "1_1", "2_0_0", "2_0_1", "2_1_1"]
    df = spark.createDataFrame([tuple(map(float, r[1:])) + (r[0],) for r in rows],
                               ", ".join([f"s{k} double" for k in names] + [f"t{k} double" for k in names] + ["d long"]))
    got = surv.efron_sums(df, 2).first()
    assert np.allclose([got[k] for k in ("ll", "g_0", "g_1", "h_0_0", "h_0_1", "h_1_1")], expected, rtol=1e-9)


def test_cox_in_many_chunks_with_ties_across_them(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 700
    x = rng.normal(size=(n, 2))
    t = np.where(rng.random(n) < 0.4, 6.0, np.ceil(rng.exponential(np.exp(-x @ [0.5, -0.3])) * 12) / 2)  # one time holds 40 %
    e = (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([(float(t[i]), int(e[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "t double, e int, a double, b double").repartition(5)
    whole, info = surv.cox_ph(df, "t", "e", ["a", "b"])
    expected, se = _efron_numpy(t, e, x)
    for table, found in [(whole, info)]:
        assert np.allclose([r.coef for r in table.collect()], expected, atol=1e-7)
        assert np.allclose([r.se_coef for r in table.collect()], se, atol=1e-7)
    for size, per, ties in ((37, 10**6, 10**6), (16, 50, 20)):
        monkeypatch.setattr(surv, "COX_CHUNK", size)
        monkeypatch.setattr(surv, "TIES_ON_DRIVER", ties)
        monkeypatch.setattr(surv, "range_count", lambda rows, per=per: max(1, rows // per))
        table, found = surv.cox_ph(df, "t", "e", ["a", "b"])
        assert found["log_likelihood"] == pytest.approx(info["log_likelihood"], rel=1e-12)
        assert np.allclose([r.coef for r in table.collect()], expected, atol=1e-7)


def test_cox_that_does_not_converge_is_an_error(c360):
    with pytest.raises(RuntimeError, match="converge"):
        surv.cox_ph(c360, "tenure_months", "churn_flag", surv.COX_COVARIATES, max_iter=1)


def test_successive_differences_by_text_and_large_keys(spark, small_ranges):
    rng = np.random.default_rng(8)
    v = rng.normal(size=60)
    for keys, kind in (([f"T-{i:04d}" for i in range(60)], "string"), ([(1 << 60) + i for i in range(60)], "long")):
        order = rng.permutation(60).tolist()
        df = spark.createDataFrame([(keys[i], float(v[i])) for i in order], f"k {kind}, v double")
        assert ordered.successive_diff_sq_sum(df, "k", "v") == pytest.approx((np.diff(v) ** 2).sum())


def test_gram_keeps_three_decimals(spark):
    from retentia.operators import stats
    df = spark.createDataFrame([(1.005, 1.0), (1.0049, 2.0)], "x double, y double")
    got = {(r.row_var, r.col_var): r.value for r in stats.gram(df, "y", ["x"]).collect()}
    assert got["x", "x"] == pytest.approx(1.005 ** 2 + 1.0049 ** 2, abs=1e-12)


def test_correlation_is_one_pass_without_generated_rows(spark):
    from retentia.operators import stats
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = stats.correlation(df, ["a", "b", "c"], digits=9)
    got = {(r.var_a, r.var_b): r.r for r in out.collect()}
    import pandas as pd
    expected = pd.DataFrame(rows, columns=["a", "b", "c"]).corr()
    assert len(got) == 9 and all(got[p, q] == pytest.approx(expected.loc[p, q], abs=1e-8) for p in "abc" for q in "abc")


def test_tail_columns_match_the_driver_functions(spark):
    from retentia.functions import tails
    from retentia.functions.distributions import chi2_sf, f_sf
    rows = [(x, d) for x in (0.0014, 0.5, 3.84, 12.0, 40.0) for d in (1, 2, 3, 4, 7, 10)]
    df = spark.createDataFrame(rows, "x double, d int")
    for r in df.select("x", "d", tails.chi2_tail(F.col("x"), F.col("d")).alias("p")).collect():
        assert r.p == pytest.approx(chi2_sf(r.x, r.d), rel=1e-6, abs=1e-13)
    df = spark.createDataFrame([(f, a, b) for f in (0.2, 1.0, 4.5) for a in (2, 4, 6) for b in (5, 60, 600)], "f double, a int, b int")
    for r in df.select("f", "a", "b", tails.f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == pytest.approx(f_sf(r.f, r.a, r.b), rel=1e-6)


def test_survival_over_many_ranges_of_continuous_times(spark, monkeypatch):
    from retentia.operators import ordered
    rng = np.random.default_rng(5)
    n = 4000
    t, e, g = rng.exponential(10, n), (rng.random(n) < 0.6).astype(int), np.where(rng.random(n) < 0.9, "a", "b")
    df = spark.createDataFrame([(float(t[i]), int(e[i]), str(g[i])) for i in range(n)], "t double, e int, g string")
    one = {k: f.orderBy("g", "t").collect() if "g" in f.columns else f.collect() for k, f in {
        "km": surv.kaplan_meier(df, "t", "e", ["g"]), "ci": surv.kaplan_meier_confidence(df, "t", "e", ["g"]),
        "nb": surv.naive_survival(df, "t", "e", ["g"])}.items()}
    rank = surv.logrank(df, "t", "e", "g", "a", "b").first()
    monkeypatch.setattr(ordered, "range_count", lambda rows, per=0: 13)  # thirteen ranges
    many = {"km": surv.kaplan_meier(df, "t", "e", ["g"]), "ci": surv.kaplan_meier_confidence(df, "t", "e", ["g"]), "nb": surv.naive_survival(df, "t", "e", ["g"])}
    for k, f in many.items():
        assert [tuple(r) for r in f.orderBy("g", "t").collect()] == [tuple(r) for r in one[k]]
        plan = f._jdf.queryExecution().toString()
        assert "_bucket" in plan
    assert surv.logrank(df, "t", "e", "g", "a", "b").first() == rank
    for name in ("a", "b"):  # the plain product over the group's times
        at = np.sort(t[g == name])
        s, expected = 1.0, {}
        for x in at:
            s *= 1 - e[(g == name) & (t == x)].sum() / (at >= x).sum()
            expected[x] = round(s, 6)
        assert {r.t: r.survival for r in one["km"] if r.g == name and r.t > 0} == pytest.approx(expected, abs=1.1e-6)


def test_qr_regression_of_an_ill_conditioned_design(spark):
    rng = np.random.default_rng(11)
    n = 3000
    a = rng.normal(size=n)
    x = np.column_stack([a, a + 1e-7 * rng.normal(size=n), rng.normal(size=n)])  # condition about 1e7
    beta = np.array([2.0, -1.0, 0.5])
    y = 3.0 + x @ beta + 1e-9 * rng.normal(size=n)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(n)], "id long, y double, a double, b double, c double").repartition(6)
    m = st.OLSResult(df, "y", ["a", "b", "c"], "id")
    assert np.allclose(m.coef, [3.0, *beta], atol=2e-2) and np.allclose(m.coef[[0, 3]], [3.0, 0.5], atol=1e-9)
    q = np.linalg.lstsq(np.column_stack([np.ones(n), x]), y, rcond=None)[0]
    assert np.allclose(m.coef, q, rtol=1e-5, atol=1e-9)
    cond = m.diagnostics().first().cond_no
    assert cond == pytest.approx(np.linalg.cond(np.column_stack([np.ones(n), x])), rel=1e-6) and cond > 1e7
    r = m.fit().first()
    assert r.n == n and r.df_resid == n - 4 and r.r_squared == pytest.approx(1.0) and not m.singular


def test_qr_regression_against_lstsq_and_singular_designs(spark):
    rng = np.random.default_rng(12)
    n = 500
    x = rng.normal(size=(n, 2)) * [1.0, 1e4]
    y = 1.0 + x @ [0.5, -2e-4] + rng.normal(size=n)
    rows = [(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double").repartition(9)
    m = st.OLSResult(df, "y", ["a", "b"])
    d = np.column_stack([np.ones(n), x])
    beta, ssr, *_ = np.linalg.lstsq(d, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(d.T @ d)) * ssr[0] / (n - 3))
    got = m.coefficients().collect()
    assert np.allclose([r.coef for r in got], beta) and np.allclose([r.std_err for r in got], se)
    assert m.fit().first().r_squared == pytest.approx(1 - ssr[0] / ((y - y.mean()) ** 2).sum())
    twice = st.OLSResult(df.withColumn("c", F.col("a") * 2), "y", ["a", "c"])
    assert twice.singular and all(r.std_err is None for r in twice.coefficients().collect())
    few = st.OLSResult(df.limit(2), "y", ["a", "b"])
    assert few.fit().first().f_statistic is None


def test_tails_for_any_degrees_of_freedom(spark):
    from retentia.functions import tails
    from retentia.functions.distributions import f_sf, t_sf_two_sided
    cases = [(f, d1, d2) for f in (0.0, 1e-6, 0.3, 1.0, 2.7, 11.0, 400.0) for d1 in range(1, 9) for d2 in (1, 2, 7, 30, 1000, 250000)]
    df = spark.createDataFrame([(float(f), d1, d2) for f, d1, d2 in cases], "f double, d1 int, d2 int")
    got = {(r.f, r.d1, r.d2): (r.p, r.t) for r in df.select(
        "f", "d1", "d2", tails.f_tail(F.col("f"), F.col("d1"), F.col("d2")).alias("p"), tails.t_tail_two_sided(F.col("f"), F.col("d2")).alias("t")).collect()}
    for f, d1, d2 in cases:
        assert got[f, d1, d2][0] == pytest.approx(f_sf(f, d1, d2), rel=1e-7, abs=1e-12), (f, d1, d2)
        assert got[f, d1, d2][1] == pytest.approx(t_sf_two_sided(f, d2), rel=1e-6, abs=1e-6), (f, d2)
    none = spark.range(1).select(tails.f_tail(F.lit(None).cast("double"), F.lit(3), F.lit(5)), tails.f_tail(F.lit(2.0), F.lit(0), F.lit(5))).first()
    assert none[0] is None and none[1] is None


def test_anova_has_a_p_value_for_any_number_of_groups(spark):
    from retentia.functions.distributions import f_sf
    rng = np.random.default_rng(3)
    for k in range(2, 9):
        rows = [(f"g{i % k}", Decimal(str(round(float(rng.normal(1e9 + i % k * 0.4, 1)), 2)))) for i in range(40 * k)]
        r = st.anova(spark.createDataFrame(rows, "g string, v decimal(18,2)"), "v", "g").first()
        v, g = np.array([float(x - 10**9) for _, x in rows]), np.array([x for x, _ in rows])
        means = {x: v[g == x].mean() for x in set(g)}
        ssb = sum((g == x).sum() * (m - v.mean()) ** 2 for x, m in means.items())
        ssw = sum(((v[g == x] - m) ** 2).sum() for x, m in means.items())
        f = (ssb / (k - 1)) / (ssw / (len(v) - k))
        assert r.f_statistic == pytest.approx(f, abs=1e-5) and r.ss_within == pytest.approx(ssw, abs=0.01)  # no digits lost at 1e9
        assert r.p_value == pytest.approx(f_sf(f, k - 1, len(v) - k), abs=1e-4) and r.p_value is not None
