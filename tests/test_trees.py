"""Tree ensembles against plain NumPy versions that look at every row and cut."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from retentia.operators import trees as tr


def frame(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n), rng.integers(0, 2, n), np.ones(n), rng.normal(size=n)])
    y = (x[:, 0] + (x[:, 1] > 3) - x[:, 2] * x[:, 4] + rng.normal(size=n) * 0.5 > 0.3).astype(int)
    x[rng.random(n) < 0.1, 0] = np.nan
    rows = [(i, int(y[i]), int(i % 3), [None if math.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "account_id long, y int, fold int, inputs array<double>"), x, y, np.arange(n) % 3


def plain_boost(codes, sizes, y, par):
    """Row by row: the trees of second-order boosting."""
    margin, out = np.zeros(len(y)), []
    for _ in range(par.trees):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, par.positive_weight, 1.0)
        g, h = np.rint(w * (p - y) * tr.FIXED) / tr.FIXED, np.rint(w * p * (1 - p) * tr.FIXED) / tr.FIXED
        tree, open_ = {}, [(0, np.arange(len(y)), 0)]
        while open_:
            node, rows, depth = open_.pop(0)
            best = (1e-6, None)
            if depth < par.depth:
                for f in range(codes.shape[1]):
                    c, miss = codes[rows, f], codes[rows, f] == tr.MISSING
                    for cut in range(sizes[f]):
                        for side in (False, True):
                            left = ((c <= cut) & ~miss) | (miss & side)
                            gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                            if min(hl, hr) < par.min_hessian:
                                continue
                            gain = round(gl**2 / (hl + par.leaf_l2) + gr**2 / (hr + par.leaf_l2) - (gl + gr) ** 2 / (hl + hr + par.leaf_l2), 9)
                            if gain > best[0]:
                                best = (gain, (f, cut, side, left))
            if best[1]:
                f, cut, side, left = best[1]
                tree[node] = (f, cut, side)
                open_ += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
            else:
                margin[rows] += (leaf := -par.eta * g[rows].sum() / (h[rows].sum() + par.leaf_l2))
                tree[node] = leaf
        out.append(tree)
    return out, margin


def as_dict(tree):
    out, open_ = {}, [0]
    while open_:
        n = open_.pop(0)
        if tree.split[n] >= 0:
            out[n] = (int(tree.split[n]), int(tree.cut[n]), bool(tree.left[n]))
            open_ += [2 * n + 1, 2 * n + 2]
        else:
            out[n] = float(tree.value[n])
    return out


def same(a, b):
    return set(a) == set(b) and all(a[n] == b[n] if isinstance(a[n], tuple) else a[n] == pytest.approx(b[n], abs=1e-9) for n in a)


def test_boosting_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(tr, "TREES_PER_WRITE", 2)
    monkeypatch.setattr(tr, "ROWS_AT_LEAST", 80)
    df, x, y, fold = frame(spark)
    cuts = tr.cut_points(df, "inputs", 5, 16)
    codes, sizes = tr.bin_codes(x, cuts), [len(c) for c in cuts]
    assert (codes[np.isnan(x)] == tr.MISSING).all()
    par = tr.Boosting(5, 3, 0.3, positive_weight=2.0)
    got = tr.boost(tr.binned(df, "account_id", "y", "inputs", cuts, "fold"), cuts, [-2, 1], par, 16)
    for trees, rows in zip(got, (fold >= 0, fold != 1)):
        expected, margin = plain_boost(codes[rows], sizes, y[rows], par)
        assert all(same(as_dict(a), b) for a, b in zip(trees, expected))
        assert np.allclose(tr.margins(trees, codes[rows]), margin)


def test_trees_do_not_depend_on_partitions(spark, monkeypatch):
    df, *_ = frame(spark)
    cuts = tr.cut_points(df, "inputs", 5, 16)
    found = []
    for rows, per in ((df, 1000), (df.orderBy(F.desc("account_id")).repartition(7), 20)):
        monkeypatch.setattr(tr, "ROWS_AT_LEAST", per)
        table = tr.binned(rows, "account_id", "y", "inputs", cuts, "fold")
        found.append(([t.record() for t in tr.boost(table, cuts, [-2], tr.Boosting(3, 3), 16)[0]],
                      [t.record() for t in tr.forest(table, cuts, [-2], {-2: (1.0, 1.0)}, tr.Forest(5, 4), 16)[0][0]]))
    assert found[0] == found[1]


def plain_forest_tree(codes, sizes, y, weight, class_weights, t, par, width, drawn):
    tree, gained, open_ = {}, np.zeros(width), [(0, np.flatnonzero(weight > 0), 0)]

    def gini(rows):
        a = np.array([(weight[rows] * (y[rows] == c)).sum() * class_weights[c] for c in (0, 1)])
        return a.sum() - (a**2).sum() / a.sum() if a.sum() else 0.0
    while open_:
        node, rows, depth = open_.pop(0)
        best = (1e-9, None)
        if depth < par.depth and len(rows) >= par.min_split and 0 < y[rows].sum() < len(rows):
            order = tr.drawn_inputs(t, node, width, par.seed)
            for at in range(0, width, drawn):
                for f in order[at: at + drawn]:
                    c, miss = codes[rows, f], codes[rows, f] == tr.MISSING
                    for cut in range(sizes[f]):
                        for side in (False, True):
                            left = ((c <= cut) & ~miss) | (miss & side)
                            if left.all() or not left.any():
                                continue
                            drop = round(gini(rows) - gini(rows[left]) - gini(rows[~left]), 9)
                            if drop > best[0]:
                                best = (drop, (int(f), cut, side, left))
                if best[1]:
                    break
        if best[1]:
            f, cut, side, left = best[1]
            tree[node] = (f, cut, side)
            gained[f] += best[0]
            open_ += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
        else:
            a = [(weight[rows] * (y[rows] == c)).sum() * class_weights[c] for c in (0, 1)]
            tree[node] = a[1] / sum(a)
    return tree, gained


def test_forest_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(tr, "ROWS_AT_LEAST", 80)
    monkeypatch.setattr(tr, "CELLS_PER_PASS", 600)
    df, x, y, fold = frame(spark, 200, 3)
    hashes = np.array([r[0] for r in df.orderBy("account_id").select(F.xxhash64("account_id")).collect()])
    cuts = tr.cut_points(df, "inputs", 5, 16)
    codes, sizes = tr.bin_codes(x, cuts), [len(c) for c in cuts]
    par, cw = tr.Forest(6, 4, 5, 7), {-2: (0.7, 1.9), 0: (1.0, 1.0)}
    got, importances = tr.forest(tr.binned(df, "account_id", "y", "inputs", cuts, "fold"), cuts, [-2, 0], cw, par, 16)
    for trees, m, imp in zip(got, (-2, 0), importances):
        total = []
        for t, tree in enumerate(trees):
            weight = np.where(fold != m, tr.bootstrap_weights(hashes, t, par.seed), 0)
            expected, gained = plain_forest_tree(codes, sizes, y, weight, cw[m], t, par, 5, 2)
            assert same(as_dict(tree), expected)
            total.append(gained / gained.sum())
        assert np.allclose(imp, np.mean(total, 0)) and imp[3] == 0


def test_bootstrap_weights_are_poisson():
    w = np.concatenate([tr.bootstrap_weights(np.arange(20000, dtype=np.int64), t, 42) for t in range(5)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs((w == 0).mean() - math.exp(-1)) < 0.01


def test_no_rows_no_split_and_one_class(spark):
    df, *_ = frame(spark, 40)
    cuts = tr.cut_points(df, "inputs", 5, 16)
    same_label = tr.binned(df.withColumn("y", F.lit(1)), "account_id", "y", "inputs", cuts)
    assert (tr.boost(same_label, cuts, [-2], tr.Boosting(2, 2), 16)[0][0].split == -1).all()
    assert tr.forest(same_label, cuts, [-2], {-2: (1.0, 1.0)}, tr.Forest(2, 2), 16)[0][0][0].value[0] == 1.0
    nothing = tr.binned(df.limit(0), "account_id", "y", "inputs", cuts)
    assert (tr.boost(nothing, cuts, [-2], tr.Boosting(2, 2), 16)[0][0].split == -1).all()


def test_ensemble_stage_is_saved_and_loaded(spark, tmp_path):
    df, x, y, _ = frame(spark, 120)
    cuts = tr.cut_points(df, "inputs", 5, 16)
    trees = tr.boost(tr.binned(df, "account_id", "y", "inputs", cuts), cuts, [-2], tr.Boosting(3, 3, 0.3), 16)[0]
    PipelineModel([tr.TreeEnsemble.of("boosting", cuts, trees)]).write().overwrite().save(str(tmp_path / "m"))
    scored = PipelineModel.load(str(tmp_path / "m")).transform(df.withColumnRenamed("inputs", "_inputs")).orderBy("account_id").collect()
    assert np.allclose([r.probability_1 for r in scored], tr.ensemble_probability("boosting", trees, tr.bin_codes(x, cuts)))


def test_one_of_two_siblings_is_summed(spark, monkeypatch):
    asked, summed = [], tr._summed
    monkeypatch.setattr(tr, "_summed", lambda parts, n, *rest: asked.append(n) or summed(parts, n, *rest))
    df, *_ = frame(spark)
    cuts = tr.cut_points(df, "inputs", 5, 16)
    tr.boost(tr.binned(df, "account_id", "y", "inputs", cuts, "fold"), cuts, [-2, 1], tr.Boosting(2, 3, 0.3), 16)
    assert len(asked) == 6 and all(n <= most for n, most in zip(asked, [2, 2, 4] * 2))
