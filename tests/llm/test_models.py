"""The trained operators: gradients, probabilities, held-out accuracy and defined results."""

import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retentia.llm import lm_score, quality_cnn, toxicity

DATA = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = np.asarray(label) > 0
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


# masked pseudo-likelihood

def test_conditional_probabilities_sum_to_one():
    net = lm_score.Network.start()
    net.flat += np.random.default_rng(0).standard_normal(len(net.flat)).astype(np.float32) * 0.1
    around = np.repeat(np.array([[1, 2, 3, 4]]), lm_score.VOCAB, 0)
    assert abs(np.exp(net.log_probs(around, np.arange(lm_score.VOCAB))).sum() - 1) < 1e-3


def test_steps_raise_the_likelihood():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 50, (4000, 4))
    token = (left[:, 1] * 3 + 5) % lm_score.VOCAB  # the word before decides
    net = lm_score.Network.start()
    before = net.log_probs(left, token).mean()
    for _ in range(300):
        net.step(left, token, 1.0)
    assert net.log_probs(left, token).mean() > before + 3


def test_neighbours_never_hold_the_token_itself():
    around, token, row, place = lm_score._around([np.array([7, 8, 9], "<u2").tobytes(), b"", np.array([5], "<u2").tobytes()])
    pad = lm_score.VOCAB
    assert around.tolist() == [[pad, pad, 8, 9], [pad, 7, 9, pad], [7, 8, pad, pad], [pad] * 4]
    assert token.tolist() == [7, 8, 9, 5] and row.tolist() == [0, 0, 0, 2] and place.tolist() == [0, 1, 2, 0]


def test_lm_step_against_one_row_at_a_time():
    r = np.random.default_rng(3)
    around, token = r.integers(0, lm_score.VOCAB + 1, (300, 4)), np.minimum(r.zipf(1.3, 300) - 1, lm_score.VOCAB - 1)
    net = lm_score.Network.start()
    for name in ("classes", "class_bias", "tokens", "token_bias"):
        getattr(net, name)[:] = r.standard_normal(getattr(net, name).shape) * 0.1
    old, want = lm_score.Network(net.flat.astype(float)), lm_score.Network(net.flat.astype(float))
    rate, boost = 0.2 / 300, lm_score.CLASSES ** 0.5
    for near, t in zip(around, token, strict=True):
        x = old.embed[near].ravel()
        h, (c, k) = np.tanh(x @ old.hidden + old.hidden_bias), divmod(t, lm_score.CLASS)
        d, e = (np.exp(z) / np.exp(z).sum() for z in (h @ old.classes + old.class_bias, h @ old.tokens[c] + old.token_bias[c]))
        assert abs(np.log(d[c] * e[k]) - net.log_probs(near[None], np.array([t]))[0]) < 1e-4
        d[c] -= 1
        e[k] -= 1
        dpre = (old.classes @ d + old.tokens[c] @ e) * (1 - h * h)
        want.classes -= rate * np.outer(h, d)
        want.class_bias -= rate * d
        want.tokens[c] -= rate * boost * np.outer(h, e)
        want.token_bias[c] -= rate * boost * e
        want.hidden -= rate * np.outer(x, dpre)
        want.hidden_bias -= rate * dpre
        np.subtract.at(want.embed, near, rate * 8 * (old.hidden @ dpre).reshape(4, -1))
    net.step(around, token, 0.2)
    assert np.abs(net.flat - want.flat).max() < 1e-5


def test_lm_steps_reuse_their_memory():
    code = """
import resource
import numpy as np
from retentia.llm import lm_score
r = np.random.default_rng(0)
ids = [r.integers(0, lm_score.VOCAB, 300).astype("<u2").tobytes() for _ in range(400)]
import pyarrow as pa
list(lm_score._train([pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])], lm_score.Network.start().flat, 0))
net = lm_score.Network.start()
faults = []
for _ in range(30):
    at = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    net.step(r.integers(0, lm_score.VOCAB, (2048, 4)), r.integers(0, lm_score.VOCAB, 2048), 0.1)
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - at)
print(sorted(faults)[15])
"""
    env = {**os.environ, "OMP_NUM_THREADS": "1", "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120, check=True)
    assert int(out.stdout) < 200


def test_lm_scores(spark, make_docs):
    r = random.Random(1)
    sentence = ["the cat sat on the mat and then it ran away from here", "a dog is in the house of my old friend today"]
    rows = [(i, " ".join(r.choice(sentence) for _ in range(40))) for i in range(300)]
    mixed = rows[0][1].split()
    r.shuffle(mixed)
    rows += [(1000, " ".join(mixed)), (1001, None), (1002, " \n"), (1003, "cat"), (None, rows[0][1]), (0, rows[0][1])]
    got = {}
    for x in lm_score.score(make_docs(rows)).collect():
        assert got.setdefault(x.doc_id, x) == x
    assert len(got) == 305
    assert got[0].n_tokens == len(rows[0][1].split()) and abs(got[0].log_prob / got[0].n_tokens - got[0].mean_log_prob) < 1e-9
    assert got[0].mean_log_prob > got[1000].mean_log_prob + 0.1
    assert (got[1001].n_tokens, got[1001].log_prob, got[1001].mean_log_prob) == (0, 0.0, None) == tuple(got[1002])[1:]
    assert got[1003].n_tokens == 1 and got[None].log_prob == got[0].log_prob
    assert lm_score.score(make_docs([])).count() == 0


def many_words():
    """Clean texts over 6,000 words, and junk: words that occur once."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, 120), 6000))) for i in range(300)]
    rows += [(500 + i, " ".join(f"w{k}" for k in rng.integers(1, 6001, 120))) for i in range(300)]
    return rows + [(1000 + i, " ".join(f"x{rng.integers(1 << 60)}" for _ in range(120))) for i in range(20)]


def test_junk_words_score_below_clean_text(make_docs):
    got = {r.doc_id: r.mean_log_prob for r in lm_score.score(make_docs(many_words())).collect()}
    clean, spread, junk = (np.array([got[i] for i in ids]) for ids in (range(300), range(500, 800), range(1000, 1020)))
    assert clean.min() > junk.max() and spread.mean() > junk.max()


def test_joined_counts_score_like_held_ones(make_docs, monkeypatch):
    docs = make_docs(many_words() + [(2000, None), (1000, many_words()[600][1])])
    held = sorted(lm_score.score(docs).collect(), key=str)
    for words in (3000, 0):
        monkeypatch.setattr(lm_score, "HELD", words)
        joined = sorted(lm_score.score(docs).collect(), key=str)
        assert [(r.doc_id, r.n_tokens) for r in joined] == [(r.doc_id, r.n_tokens) for r in held]
        assert all(abs((a.log_prob or 0) - (b.log_prob or 0)) < 1e-2 for a, b in zip(held, joined, strict=True))


def test_every_token_is_a_training_target_once():
    docs = [np.arange(n).astype("<u2").tobytes() for n in (1, 2, 3, 50, 0, 1)]
    flat, seen = lm_score.Network.start().flat, 0
    for turn in range(lm_score.ROUNDS):
        for out in lm_score._train([pa.RecordBatch.from_arrays([pa.array(docs, pa.binary())], ["ids"])], flat, turn):
            seen += out.column("change")[-1].as_py()  # the last place counts tokens
    assert seen == 57
    place = np.arange(100)
    assert (sum(lm_score._targets(place, turn).astype(int) for turn in range(lm_score.ROUNDS)) == 1).all()


# byte-level network

def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 64, 65, 512, 513, 960, 961, 5000):
        x, row = quality_cnn.cut(np.arange(n).astype(np.uint8), np.array([0, n]))
        seen = np.zeros(n, bool)
        for s in quality_cnn.chunk_starts(n):
            seen[s: s + quality_cnn.CHUNK] = True
        assert seen.all() and len(x) == len(row) == len(quality_cnn.chunk_starts(n))
        if n:
            assert x[0, : min(n, 512)].tolist() == [i % 256 for i in range(min(n, 512))]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = quality_cnn.Network(3)
    x, y, w = rng.integers(0, 256, (6, quality_cnn.CHUNK)).astype(np.int16), np.array([0, 1, 0, 1, 1, 0], np.float32), np.ones(6, np.float32)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        h = []
        wd = net._windows(x)
        pooled = np.maximum((wd.reshape(-1, wd.shape[2]) @ net.filters).reshape(*wd.shape[:2], -1).max(1) + net.bias, 0)
        z = (np.maximum(pooled @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias)[:, 0]
        h = np.log1p(np.exp(-np.where(y > 0, z, -z)))
        return h.mean()
    grads = net.gradients(x, y, w)
    for name, place in (("filters", (5, 3)), ("hidden", (2, 1)), ("out", (4, 0)), ("out_bias", (0,)), ("bias", (7,)), ("embed", (int(x[0, 100]), 2))):
        value, eps = getattr(net, name), 1e-5
        value[place] += eps
        up = loss()
        value[place] -= 2 * eps
        down = loss()
        value[place] += eps
        assert abs((up - down) / (2 * eps) - grads[name][place]) < 1e-4 + 0.02 * abs(grads[name][place]), name


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality_cnn.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    held = got.filter("held_out").join(labels, "doc_id").collect()
    assert auc(np.array([r.score for r in held]), np.array([r.quality for r in held])) > 0.9
    clean = [r.predicted for r in held if r.quality == 1]
    assert np.mean(clean) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held)


def test_quality_edge_cases(spark, make_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, ("good words here " if i % 2 else "#$%&* ") * 30) for i in range(40)] + [(100, None), (101, ""), (None, "x"), (1, "good words here " * 30), (102, "y" * 100000)]
    docs = make_docs(rows)
    got = quality_cnn.score(docs, labels).collect()
    assert len(got) == len(rows) and next(r for r in got if r.doc_id is None).held_out
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    alone = quality_cnn.score(docs, labels.limit(0)).collect()
    assert {r.score for r in alone} == {0.5}
    assert quality_cnn.score(make_docs([]), labels).count() == 0


# ordinal regression

def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    n = 3000
    x = rng.integers(0, 2, (n, 3))
    eta = x @ np.array([3.0, -2.0, 1.0]) + rng.logistic(size=n)
    grade = (eta > 1).astype(int) + (eta > 2.5) + (eta > 4)
    row, at = np.nonzero(x)
    w, cuts = toxicity.fit(at, np.ones(len(at)), row, grade, 3, l2=1e-5)
    assert np.allclose(w, [3, -2, 1], atol=0.35) and np.allclose(cuts, [1, 2.5, 4], atol=0.35) and (np.diff(cuts) > 0).all()


def test_toxicity_on_the_labelled_table(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    fold = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(4)) == 0
    got = toxicity.score(docs, labels.filter(~fold)).withColumnRenamed("toxic", "said").join(labels.filter(fold), "doc_id").collect()
    assert auc(np.array([r.severity for r in got]), np.array([r.toxic for r in got])) > 0.85
    clean = [r.said for r in got if not r.toxic]
    assert np.mean(clean) < 0.03
    assert all(0 <= r.severity <= 3 for r in got)


@pytest.mark.parametrize("with_labels", [True, False])
def test_toxicity_edge_cases(spark, make_docs, with_labels):
    rows = [(i, f"some plain text number {i % 7} here" + (" vile" if i % 4 == 0 else "")) for i in range(200)] + [(900, None), (901, ""), (None, "vile vile vile"), (0, "vile"), (902, "plain " * 50000)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (2, 1, None)] if with_labels else [], "doc_id long, quality int, toxic int")
    got = toxicity.score(make_docs(rows), labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 0}
    if with_labels:
        assert by[4].toxic == 1 and by[5].toxic == 0 and by[900].toxic == 0 and by[None].severity > by[4].severity > by[5].severity
    else:
        assert all(r.severity < 1e-6 and r.toxic == 0 for r in got)
    assert toxicity.score(make_docs([]), labels).count() == 0


def test_training_sample_is_bounded_by_rows(spark):
    """One id with most rows does not pass the bound."""
    from retentia.llm.common import bounded_sample
    rows = spark.createDataFrame([(f"text {i % 3000}", i % 2) for i in range(9000)] + [(None, 0)] * 50, "text string, quality int")
    assert bounded_sample(rows, 10_000, "t").count() == 9050
    got = bounded_sample(rows, 1000, "t")
    assert 850 < got.count() < 1150 and {r.quality for r in got.collect()} == {0, 1}


@pytest.mark.parametrize("method", [quality_cnn, toxicity])
def test_repeated_labels_and_rows(spark, make_docs, method):
    rng = random.Random(4)
    good, bad = ["the old house by the lake was sold in spring"], ["zxq $$$ buy click zxq now"]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad).split()[: 4 + i % 5]) + f" {i}") for i in range(80)] + [(7, "same id " + str(k)) for k in range(60)]
    marks = [(i, i % 2, 1 - i % 2) for i in range(80)] + [(7, 1, 0)] * 200 + [(7, 0, 1)] * 3
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = method.score(make_docs(rows), labels).collect()
    assert len(got) == len(rows)
