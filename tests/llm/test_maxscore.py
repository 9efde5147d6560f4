"""Exact top-k search against scoring everything."""

import math
import random

import numpy as np
import pandas as pd

from retentia.llm import maxscore

SCHEMA = "vec_id long, embedding array<float>, label int, shard long, v string, n string, query_hash string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, e, 0, 1, "x", "y", "z") for i, e in rows], SCHEMA.replace("float", kind))


def brute(rows, k=5, every=50):
    whole = [(n, i, [math.floor(256 * x) for x in e]) for n, (i, e) in enumerate(rows)
             if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, i, q in whole:
        if i is not None and i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in whole if m != n)[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scores)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=str)


def test_top_k_matches_brute_force(spark, monkeypatch):
    r = random.Random(1)
    vector = lambda n=8: [float(np.float32(r.gauss(0, 0.3))) for _ in range(n)]
    common = vector()
    rows = [(i, vector()) for i in range(600)] + [(1000 + i, common) for i in range(300)]
    rows += [(0, rows[0][1])] * 3 + [(50, common)] * 4 + [(100, vector()), (None, common), (None, vector()), (-50, vector())]
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, [3.0]), (2300, vector(12)), (2250, [3.0, 0.0])]
    expected = brute(rows)
    assert got(maxscore.top_k(table(spark, rows))) == expected
    monkeypatch.setattr(maxscore, "SHARD", 64)
    monkeypatch.setattr(maxscore, "BLOCK", 5)
    monkeypatch.setattr(maxscore, "SEEDS", 16)
    assert got(maxscore.top_k(table(spark, rows))) == expected


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**22 + i, -(2.0**21), 2.0 ** (i % 7)]) for i in range(40)] + [(50, [2.0**22, 2.0**20, 1.0])]
    assert got(maxscore.top_k(table(spark, rows, "double"))) == brute(rows)
    rows = [(i, [2.0**40 + i]) for i in range(4)] + [(50, [-(2.0**41)])]  # beyond a long: equal scores, ranked by id
    assert got(maxscore.top_k(table(spark, rows, "double"))) == [(0, i, i, 2**63 - 1) for i in (1, 2, 3)] + [(0, 4, 50, -2**63)] + [(50, i + 1, i, -2**63) for i in range(4)]


def test_few_rows(spark):
    assert got(maxscore.top_k(table(spark, []))) == []
    assert got(maxscore.top_k(table(spark, [(0, [1.0])]))) == []
    assert got(maxscore.top_k(table(spark, [(1, [1.0]), (2, [1.0])]))) == []
    assert got(maxscore.top_k(table(spark, [(0, [1.0]), (2, [-1.0])]))) == [(0, 1, 2, -65536)]


def test_pruning_keeps_every_competitor():
    rng = np.random.default_rng(4)
    docs = rng.integers(-30, 30, (400, 16)).astype(np.float32)
    docs[:, 0] *= 20  # one term decides: the rest is non-essential
    postings = np.ascontiguousarray(docs.T)
    for q in rng.integers(-9, 9, (50, 16)).astype(np.float32):
        exact = docs @ q
        beat = np.sort(exact)[-6]
        places, score = maxscore.competitors(q, postings, postings.max(1), postings.min(1), beat)
        assert (score == exact[places]).all()
        assert set(np.flatnonzero(exact >= beat)) <= set(places.tolist())
    assert len(places) < 100


def test_sides_without_rows():
    none = pd.DataFrame({"vec_id": [], "v": [], "n": []})
    assert len(maxscore.search_shard(none, none.assign(query_hash=[]), 5)) == 0
