"""Formula-level checks against figures saved by the reference (its raw
inputs are not shipped, so these replay formulas on the saved numbers)."""
import math

import pytest
from pyspark.sql import functions as F

from retentia.functions.distributions import chi2_sf, f_sf, normal_sf
from retentia.operators import metrics as met
from retentia.operators import revenue as rev

# The saved 12-month forecast (start MRR, monthly additions,
# projected totals) and the saved confusion matrices with their metrics.
FORECAST_START = 11338747.0
FORECAST_ADDED = [1297779.55, 1363806.09, 1429832.63, 1495859.17, 1561885.71, 1627912.25,
                  1693938.79, 1759965.33, 1825991.87, 1892018.41, 1958044.95, 2024071.49]
FORECAST_TOTAL = [12432429.1, 13572451.47, 14757979.97, 15988195.5, 17262293.7, 18579484.66,
                  19938992.72, 21340056.19, 22781927.04, 24263870.77, 25785166.04, 27345104.54]
CONFUSION = [  # (tn, fp, fn, tp), accuracy, precision, recall, f1
    ((65, 13, 18, 4), 0.69, 0.2353, 0.1818, 0.2051),
    ((61, 17, 16, 6), 0.67, 0.2609, 0.2727, 0.2667),
    ((42, 36, 9, 13), 0.55, 0.2653, 0.5909, 0.3662),
]


def test_forecast_recurrence_reproduces_saved_totals(spark):
    df = spark.createDataFrame([(FORECAST_START, FORECAST_ADDED)], "start double, adds array<double>")
    got = df.select(rev.leaky_totals(F.col("adds"), F.col("start"), 12).alias("t")).first()["t"]
    for g, want in zip(got, FORECAST_TOTAL):
        assert round(g, 2) == pytest.approx(want, abs=0.011)


def test_expected_ltv_formula():
    assert round(22677.494 * 0.80 / 0.0183, 2) == pytest.approx(991365.86, abs=0.01)


@pytest.mark.parametrize("cm,acc,prec,rec,f1", CONFUSION)
def test_threshold_metrics_from_confusion(spark, cm, acc, prec, rec, f1):
    tn, fp, fn, tp = cm
    rows = ([(0, 0.1)] * tn + [(0, 0.9)] * fp + [(1, 0.1)] * fn + [(1, 0.9)] * tp)
    df = spark.createDataFrame(rows, "y int, s double")
    r = met.binary_metrics(df, "y", "s").first()
    assert r["accuracy"] == pytest.approx(acc, abs=1e-4)
    assert r["precision"] == pytest.approx(prec, abs=1e-4)
    assert r["recall"] == pytest.approx(rec, abs=1e-4)
    assert r["f1_score"] == pytest.approx(f1, abs=1e-4)
    cmr = {(x["actual"], x["predicted"]): x["count"] for x in met.confusion_matrix(df, "y", "s").collect()}
    assert cmr == {(0, 0): tn, (0, 1): fp, (1, 0): fn, (1, 1): tp}


def test_tail_probabilities():
    assert f_sf(0.4449, 5, 1169) == pytest.approx(0.8172, abs=1e-4)
    assert chi2_sf(0.0014, 2) == pytest.approx(0.9993, abs=1e-4)
    # Wald p of a saved Cox row: coef -0.011588, se 0.003671
    assert 2 * normal_sf(0.011588153662873088 / 0.003670966355063109) == pytest.approx(0.0015956, abs=1e-6)
    assert math.exp(-0.011588153662873088) == pytest.approx(0.98848, abs=1e-5)


def test_auc_with_ties_and_average_precision(spark):
    # brute force on a small fixture with tied scores
    import itertools
    rows = [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.5), (0, 0.5), (1, 0.5), (0, 0.1), (1, 0.3)]
    df = spark.createDataFrame(rows, "y int, s double")
    r = met.ranking_metrics(df, "y", "s", digits=12).first()
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg)) / (
        len(pos) * len(neg))
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-12)
    # average precision: thresholds at distinct scores, descending
    ap, prev_r = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for y, s in rows if s >= t and y == 1)
        fp = sum(1 for y, s in rows if s >= t and y == 0)
        rec = tp / len(pos)
        ap += (rec - prev_r) * tp / (tp + fp)
        prev_r = rec
    assert r["pr_auc"] == pytest.approx(ap, abs=1e-12)
