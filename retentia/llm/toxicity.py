"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are its words (lower case, outer punctuation off) and their
first four to six letters, with weight log(1 + count). Grades come from the
labels: 0 for a clean document; a toxic one gets 1, 2 or 3 by how many of its
words are markers, that is, words or word beginnings that nearly only toxic
documents have. One weight vector is shared by all thresholds:
P(grade >= k) = sigmoid(w x - t_k) with t_1 < t_2 < t_3, and the score is the
expected grade, the sum of these. A document is called toxic from the score on
that separates the fitting rows best.

The model is fitted on a bounded sample of labelled rows (``sample`` of each
label); every document is scored whole.

Defined results: null and empty texts score like a text without features;
labels that are null or have no document are not used; without both labels
present every document scores 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import bounded_sample, discard, texts

GRADES = 3
SAMPLE = 6000  # labelled rows of either label that the fit may use
FEATURES = 4000  # features that the model may have
OUTER = ".,;:!?\"'()[]{}<>|*#$%&-"
_CACHE_WORDS = 400_000


def word_features(word: str) -> list[str]:
    w = word.strip(OUTER)
    return [w, *(w[:n] + "~" for n in (4, 5, 6) if len(w) > n)] if len(w) > 1 else []


def _count(frames):
    for f in frames:
        seen: dict = {}
        for text, toxic in zip(f["text"], f["toxic"], strict=True):
            for x in {x for w in set((text or "").lower().split()) for x in word_features(w)}:
                c = seen.setdefault(x, [0, 0])
                c[toxic] += 1
        yield pd.DataFrame({"feature": list(seen), "clean": [c[0] for c in seen.values()], "toxic": [c[1] for c in seen.values()]})


class _Words(dict):
    """word -> indices of the model's features that it has."""

    def __init__(self, index):
        self.index = index

    def __missing__(self, word):
        if len(self) > _CACHE_WORDS:
            self.clear()
        got = self[word] = tuple(self.index[x] for x in word_features(word) if x in self.index)
        return got


def _counts(text: str | None, words: _Words) -> tuple[Counter, list[tuple]]:
    hits = [h for h in map(words.__getitem__, (text or "").lower().split()) if h]
    return Counter(x for h in hits for x in h), hits


def _design(frames, index, markers):
    words = _Words(index)
    for f in frames:
        out = []
        for text, toxic in zip(f["text"], f["toxic"], strict=True):
            counts, hits = _counts(text, words)
            out.append((list(counts), [float(np.log1p(c)) for c in counts.values()], int(toxic), sum(any(x in markers for x in h) for h in hits)))
        yield pd.DataFrame(out, columns=["at", "value", "toxic", "n_markers"])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(at: np.ndarray, value: np.ndarray, row: np.ndarray, grade: np.ndarray, n_features: int, l2: float = 1e-3,
        steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood of the grades (Adam)."""
    n = len(grade)
    theta = np.zeros(n_features + GRADES)
    theta[n_features:] = [1.0, 0.0, 0.0]  # t_1 and the logs of the gaps
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, cut = theta[:n_features], np.concatenate([theta[n_features:][:1], theta[n_features] + np.cumsum(np.exp(theta[n_features + 1:]))])
        eta = np.bincount(row, value * w[at], n)
        above = np.concatenate([np.ones((1, n)), sigmoid(eta - cut[:, None]), np.zeros((1, n))])  # P(grade >= k)
        slope = above * (1 - above)
        i = np.arange(n)
        p = np.maximum(above[grade, i] - above[grade + 1, i], 1e-12)
        d_eta = (slope[grade, i] - slope[grade + 1, i]) / p
        d_cut = np.zeros(GRADES)
        for k in range(1, GRADES + 1):
            d_cut[k - 1] = (-(slope[k] / p)[grade == k].sum() + (slope[k] / p)[grade == k - 1].sum()) / n
        grad = np.empty_like(theta)
        grad[:n_features] = -np.bincount(at, value * d_eta[row], n_features) / n + l2 * w
        grad[n_features] = -d_cut.sum()
        grad[n_features + 1:] = -np.cumsum(d_cut[::-1])[::-1][1:] * np.exp(theta[n_features + 1:])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        theta -= rate * first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return theta[:n_features], np.concatenate([theta[n_features:][:1], theta[n_features] + np.cumsum(np.exp(theta[n_features + 1:]))])


def cutoff(eta: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The linear score from which on a document counts as toxic: where the weighted F1 of the fitting rows is best.

    It lies in the middle of the gap between the neighbouring scores.
    """
    order = np.argsort(-eta, kind="stable")
    e, w, y = eta[order], weight[order], toxic[order] > 0
    hit = np.cumsum(w * y)
    f1 = 2 * hit / (np.cumsum(w) + (w * y).sum())
    f1[:-1][e[:-1] == e[1:]] = -1  # equal scores are not told apart
    i = int(np.argmax(f1))
    return float((e[i] + e[i + 1]) / 2) if i + 1 < len(e) else float(e[i])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, int], np.ndarray, np.ndarray, float]:
    """Feature index, weights, thresholds and the cutoff for ``toxic``."""
    marked = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic")).distinct()
    total = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return {}, np.zeros(0), np.full(GRADES, 40.0), np.inf
    share = F.when(F.col("toxic") == 1, F.lit(sample / total[1])).otherwise(F.lit(sample / total[0]))
    chosen = marked.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # chosen has about 2 * sample rows at most, as labels are distinct
    rows = bounded_sample(texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), 4 * sample, "toxic")
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {}, np.zeros(0), np.full(GRADES, 40.0), np.inf
    counted = rows.mapInPandas(_count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p1, p0 = (F.col("toxic") + 0.01) / n[1], (F.col("clean") + 0.01) / n[0]
    both = (F.col("toxic") + F.col("clean")) / (n[0] + n[1])
    z = (p1 - p0) / F.sqrt(both * (1 - both + 1e-9) * (1 / n[1] + 1 / n[0]))
    best = (counted.filter(F.col("toxic") + F.col("clean") >= 3).select("feature", "clean", "toxic", z.alias("z"))
            .filter((F.abs("z") >= 4) & ((p1 > 3 * p0) | (p0 > 3 * p1))).orderBy(F.abs("z").desc(), "feature").limit(FEATURES).collect())
    index = {r["feature"]: i for i, r in enumerate(best)}
    markers = {index[r["feature"]] for r in best if r["toxic"] / n[1] >= 19 * r["clean"] / n[0]}
    design = rows.mapInPandas(lambda f: _design(f, index, markers), "at array<int>, value array<double>, toxic int, n_markers int").collect()
    discard(rows)
    grade = np.array([r["toxic"] * (1 + (r["n_markers"] > 1) + (r["n_markers"] > 4)) for r in design])
    row = np.repeat(np.arange(len(design)), [len(r["at"]) for r in design])
    at = np.array([x for r in design for x in r["at"]], np.int64)
    value = np.array([x for r in design for x in r["value"]])
    weights, cuts = fit(at, value, row, grade, len(index))
    toxic = np.array([r["toxic"] for r in design])
    eta = np.bincount(row, value * weights[at], len(design))
    end = cutoff(eta, toxic, np.where(toxic > 0, total[1] / n[1], total[0] / n[0]))
    # back from the sample's to the corpus's share of toxic documents
    return index, weights, cuts + np.log(n[1] / n[0] * total[0] / total[1]), end


def _score(frames, model):
    index, weights, cuts, end = model
    words = _Words(index)
    for f in frames:
        eta = np.array([sum(float(np.log1p(c)) * weights[x] for x, c in sorted(_counts(t, words)[0].items())) for t in f["text"]] or [0.0])[: len(f)]
        above = sigmoid(eta[:, None] - cuts)
        yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "severity": above.sum(1), "p_toxic": above[:, 0], "toxic": (eta >= end).astype("int32")})


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Expected severity (0 to 3), chance of being toxic, and toxic 0/1 of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    return texts(docs).mapInPandas(lambda f: _score(f, model.value), "doc_id long, severity double, p_toxic double, toxic int")
