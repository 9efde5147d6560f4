"""Churn models: NumPy logistic regression, separable labels, seeds, cross-validation (sf0.001 and hand-made rows)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.operators import churn as ch


def frame(spark, seed, n=400, noise=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    c = rng.integers(0, 3, n)
    y = (x @ [1.5, -1.0] + (c == 1) + noise * rng.logistic(size=n) > 0).astype(int)
    rows = [(i, int(y[i]), float(x[i, 0]), float(x[i, 1]), ["U.S.", "U.K.", "D'E"][c[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "account_id int, churn_flag int, a double, b double, country string")


def experiment(spark, **kw):
    return ch.ChurnExperiment(frame(spark, 1, **kw), numeric=["a", "b"], categorical=["country"])


def test_logistic_matches_numpy(spark):
    exp = experiment(spark)
    model = exp.model(ch.MODEL_NAMES[0])
    got = np.append(model.stages[-1].coefficients.toArray(), model.stages[-1].intercept)
    enc, train = exp.encoding, exp.train.toPandas()
    x = np.column_stack([(train[c] - m) / s for c, m, s in zip(enc.numeric, enc.means, enc.stds)]
                        + [(train["country"] == v).astype(float) for v in enc.levels["country"][1:]] + [np.ones(len(train))])
    y = train["churn_flag"].to_numpy(float)
    w = np.where(y == 1, exp.weights[1], exp.weights[0])
    penalty = np.diag([1.0] * (x.shape[1] - 1) + [0.0])  # C = 1, the intercept is free
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (p - y)) + penalty @ beta)
    assert np.allclose(got, beta, atol=2e-3)


def test_separable_labels_are_ranked_perfectly(spark):
    exp = experiment(spark, noise=0.0)
    assert exp.evaluate(ch.MODEL_NAMES[0]).first().roc_auc > 0.995


def test_same_seed_same_forest(spark):
    one, two = (ch.ChurnExperiment(frame(spark, 1).repartition(n), numeric=["a", "b"], categorical=["country"]) for n in (1, 5))
    scores = [e.test_scores(ch.MODEL_NAMES[1]).orderBy("account_id").select("churn_probability").collect() for e in (one, two)]
    assert scores[0] == scores[1]


def test_evaluation_counts_agree_with_its_rates(spark):
    r = experiment(spark).evaluate(ch.MODEL_NAMES[0]).first()
    assert r.tp + r.fp + r.fn + r.tn == r.n and r.tp + r.fn == r.positives
    assert r.accuracy == pytest.approx((r.tp + r.tn) / r.n) and r.precision == pytest.approx(r.tp / (r.tp + r.fp))


def numpy_logistic(x, y, w):
    beta, penalty = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (p - y)) + penalty @ beta)
    return beta


def numpy_auc(y, s):
    d = s[y == 1][:, None] - s[y == 0][None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


def test_shared_newton_cross_validation_matches_numpy(spark):
    rows = frame(spark, 1).withColumn("a", F.when(F.col("account_id") % 17 == 0, None).otherwise(F.col("a")))
    exp = ch.ChurnExperiment(rows, numeric=["a", "b"], categorical=["country"])
    got = exp.cross_validate(3, models=ch.MODEL_NAMES[:1]).first()
    d = ch.stratified_folds(exp.data, 3).toPandas()
    y = d["churn_flag"].to_numpy(float)
    for f in range(3):
        tr_, va = (d["fold"] != f).to_numpy(), (d["fold"] == f).to_numpy()
        z = [((d[c] - d.loc[tr_, c].mean()) / d.loc[tr_, c].std(ddof=0)).fillna(0.0) for c in ("a", "b")]
        x = np.column_stack([*z, *[(d["country"] == v).astype(float) for v in exp.encoding.levels["country"][1:]], np.ones(len(d))])
        pos = y[tr_].mean()
        w = np.where(y[tr_] == 1, 0.5 / pos, 0.5 / (1 - pos))
        beta = numpy_logistic(x[tr_], y[tr_], w)
        assert got.folds[f].roc_auc == pytest.approx(numpy_auc(y[va], x[va] @ beta), abs=1e-9)
    assert got.mean_roc_auc == pytest.approx(np.mean([x.roc_auc for x in got.folds]))
    assert got.std_roc_auc == pytest.approx(np.std([x.roc_auc for x in got.folds]))


def test_all_families_cross_validate(spark, monkeypatch):
    monkeypatch.setattr(ch, "forest_settings", lambda v: ch.tr.Forest(12, 4, 5, 42))
    monkeypatch.setattr(ch, "boosting_settings", lambda v, w: ch.tr.Boosting(8, 3, 0.3, positive_weight=w))
    exp = experiment(spark, noise=0.3)
    got = {r.model: r for r in exp.cross_validate(3).collect()}
    assert set(got) == set(ch.MODEL_NAMES)
    assert all(r.mean_roc_auc > 0.85 and len(r.folds) == 3 for r in got.values())
    # a fold's models do not see it: the same as fitting on the other folds alone
    d = ch.stratified_folds(exp.data, 3).withColumn("_inputs", F.expr(exp.encoding.inputs()))
    cuts = ch.tr.cut_points(d, "_inputs", len(exp.encoding.feature_names))
    alone, _ = exp._tree_table(d.where("fold <> 1"))
    one = ch.tr.boost(ch.tr.binned(d.where("fold <> 1"), "account_id", "churn_flag", "_inputs", cuts), cuts, [ch.ALL_ROWS], ch.boosting_settings("a", exp.pos_weight_gbt))[0]
    va = d.where("fold = 1").toPandas()
    codes = ch.tr.bin_codes(np.stack(va["_inputs"].to_numpy()).astype(float), cuts)
    auc = numpy_auc(va["churn_flag"].to_numpy(), ch.tr.ensemble_probability("boosting", one, codes))
    assert got[ch.MODEL_NAMES[2]].folds[1].roc_auc == pytest.approx(auc, abs=1e-9)
