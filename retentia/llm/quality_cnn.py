"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover the whole of it.
Bytes are embedded, learned filters run over every other place of a chunk,
rectified answers are max-pooled over the chunk, and a hidden layer turns the
pooled vector into the chunk's logit. The mean chunk logit, calibrated on the
labelled documents, is the document's probability of label 1.

The network is trained on a bounded sample: at most about ``sample`` labelled
documents of either label (never a held-out one), with every chunk of each; the
chunks of a document share its weight. Repeated labels count once. Scoring reads every chunk of every document; memory is bounded by the
chunks of one step. Training runs from a fixed seed, so scores repeat.

Defined results: a null or empty text is one chunk of padding and gets a score
like any other; rows with a null id count as held out; without labels of both
kinds every score is the share of label 1 (0.5 if there is none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import bounded_sample, crc32_mod, discard, text_slices, texts

CHUNK, OVERLAP, PAD = 512, 64, 256
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 32, 16
SAMPLE = 1500  # labelled documents of either label that training may use
STEP_CHUNKS = 128


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of n bytes start: each shares OVERLAP bytes with the next, the last one ends the text."""
    return np.arange(0, max(1, n - OVERLAP), CHUNK - OVERLAP)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts end to end in ``data`` as (chunks x CHUNK) bytes, padded, and each one's row."""
    starts = [chunk_starts(int(n)) for n in np.diff(offsets)]
    row = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    at = np.concatenate(starts) + offsets[row] if len(starts) else np.zeros(0, np.int64)
    place = at[:, None] + np.arange(CHUNK)
    real = place < offsets[row + 1][:, None]
    out = np.full(place.shape, PAD, np.int16)
    out[real] = data[place[real]]
    return out, row


class Network:
    NAMES = ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.embed = normal(257, EMBED, scale=0.5)
        self.filters = normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5)
        self.bias = np.zeros(FILTERS, np.float32)
        self.hidden = normal(FILTERS, HIDDEN, scale=FILTERS ** -0.5)
        self.hidden_bias = np.zeros(HIDDEN, np.float32)
        self.out = normal(HIDDEN, 1, scale=HIDDEN ** -0.5)
        self.out_bias = np.zeros(1, np.float32)

    def _windows(self, x):
        e = self.embed[x]
        w = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1)[:, ::STRIDE]  # chunk, place, embed, width
        return np.ascontiguousarray(w.transpose(0, 1, 3, 2)).reshape(len(x), -1, WIDTH * EMBED)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.float32)
        for a in range(0, len(x), STEP_CHUNKS):
            w = self._windows(x[a: a + STEP_CHUNKS])
            pooled = np.maximum((w.reshape(-1, w.shape[2]) @ self.filters).reshape(*w.shape[:2], FILTERS).max(1) + self.bias, 0)
            out[a: a + STEP_CHUNKS] = (np.maximum(pooled @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias)[:, 0]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross-entropy, by back-propagation; only the pooled windows carry any."""
        n = len(x)
        w = self._windows(x)
        conv = (w.reshape(-1, w.shape[2]) @ self.filters).reshape(*w.shape[:2], FILTERS)
        best = conv.argmax(1)
        raw = np.take_along_axis(conv, best[:, None], 1)[:, 0] + self.bias
        pooled = np.maximum(raw, 0)
        h = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        p = 1 / (1 + np.exp(-np.clip((h @ self.out + self.out_bias)[:, 0], -30, 30)))
        d = ((p - y) * weight / n).astype(np.float32)[:, None]
        dh = (d @ self.out.T) * (h > 0)
        draw = (dh @ self.hidden.T) * (raw > 0)
        seen = w[np.arange(n)[:, None], best]  # chunk, filter, window
        dseen = draw[:, :, None] * self.filters.T
        dembed = np.zeros_like(self.embed)
        at = x[np.arange(n)[:, None, None], best[:, :, None] * STRIDE + np.arange(WIDTH)]
        np.add.at(dembed, at.ravel(), dseen.reshape(-1, EMBED))
        return {"embed": dembed, "filters": np.einsum("nf,nfk->kf", draw, seen), "bias": draw.sum(0), "hidden": pooled.T @ dh,
                "hidden_bias": dh.sum(0), "out": h.T @ d, "out_bias": d.sum(0)}

    def fit(self, x: np.ndarray, y: np.ndarray, share: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        mean = float((y * share).sum() / share.sum())
        weight = (share * np.where(y > 0, 0.5 / max(mean, 1e-6), 0.5 / max(1 - mean, 1e-6))).astype(np.float32)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                step += 1
                lr = rate * (1 - 0.9 * step / steps)
                for k, g in self.gradients(x[part], y[part], weight[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    setattr(self, k, (getattr(self, k) - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32))


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the weighted logistic regression of y on z, shrunk a little (Newton steps)."""
    x, beta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1.0
        beta = beta - np.clip(np.linalg.solve(hess, x.T @ (weight * (p - y)) + (beta - [1.0, 0.0])), -1, 1)
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Network | None, float, float]:
    """Network, slope and intercept of the calibration."""
    marked = (labels.filter("doc_id is not null and quality is not null").filter(crc32_mod(F.col("doc_id")) != 0)
              .select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") != 0).cast("int").alias("quality")).distinct())
    total = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}
    prior = np.clip(total.get(1, 0) / max(1, sum(total.values())), 0.01, 0.99) if total else 0.5
    nothing = None, 0.0, float(np.log(prior / (1 - prior)))
    if len(total) < 2:
        return nothing
    share = F.when(F.col("quality") == 1, F.lit(sample / total[1])).otherwise(F.lit(sample / total[0]))
    chosen = marked.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # chosen has about 2 * sample rows at most, as labels are distinct
    sampled = bounded_sample(texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "quality"), 4 * sample, "quality")
    rows = sampled.orderBy("text", "quality").collect()
    discard(sampled)
    y = np.array([r["quality"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return nothing
    raw = [(r["text"] or "").encode() for r in rows]
    x, doc = cut(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    count = np.bincount(doc)
    net = Network()
    net.fit(x, y[doc], count.mean() / count[doc])
    z = np.bincount(doc, np.concatenate([net.logits(x[i: i + 4096]) for i in range(0, len(x), 4096)])) / count
    yd = y
    weight = np.where(yd > 0, prior / max(yd.mean(), 1e-6), (1 - prior) / max(1 - yd.mean(), 1e-6))
    return net, *_calibrate(z, yd, weight)


def _score(batches, model):
    net, slope, intercept = model
    for rows, data, offsets in text_slices(batches, 1 << 19):
        n = rows.num_rows
        if net is None:
            z = np.zeros(n)
        else:
            total, count = np.zeros(n), np.zeros(n)
            for a in range(0, n, 1024):
                x, row = cut(data, offsets[a: a + 1025])
                total[a: a + 1024] += np.bincount(row, net.logits(x), min(1024, n - a))
                count[a: a + 1024] += np.bincount(row, minlength=min(1024, n - a))
            z = total / count
        p = 1 / (1 + np.exp(-np.clip(slope * z + intercept, -30, 30)))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p), pa.array((p >= 0.3).astype(np.int32))], ["doc_id", "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    scored = texts(docs).mapInArrow(lambda b: _score(b, model.value), "doc_id long, score double, predicted int")
    return scored.select("doc_id", (crc32_mod(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
