"""LM scoring by masked pseudo-likelihood with a bidirectional window network.

Tokens are the ``WORDS`` most frequent words of the whole corpus, the others
share ``OTHERS`` hashed tokens; inside its hashed token a word has its share of
the token's count in the whole corpus, discounted. A network in numpy predicts every token from
the ``SIDE`` tokens on both sides of it (the token itself is never seen):
embeddings, a hidden layer, and a two-level softmax over token classes and the
tokens of a class, so probabilities are normalised over all tokens. A
document's score is the sum of the conditional log-probabilities of all its
words: that of the token, plus that of the word given its token. Tasks hold the
counts of the ``HELD`` most frequent words; those of all others are joined.

Training is distributed: in each round every task starts from the same
parameters, takes gradient steps on the tokens of its documents whose place
falls to the round (every ``ROUNDS``-th, so that over the rounds each token of
every document is a target once), and returns the change; changes are averaged in Spark, weighted by
tokens, and added. What is counted, shuffled and trained on grows with the
corpus; the parameters that reach the driver do not.

Defined results: null, empty and blank texts have no tokens, a sum of 0 and
no mean; a text of one word is predicted from padding; repeated texts score
alike, as each text (128 bits of hash) is scored once; an empty corpus gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import materialise, split_words, text_slices, texts

WORDS, OTHERS = 1984, 64
VOCAB = WORDS + OTHERS
CLASS = 64  # tokens of a class
CLASSES = VOCAB // CLASS
SIDE, EMBED, HIDDEN = 2, 16, 32
ROUNDS, BATCH = 3, 2048
RATE = 0.3
HELD = 1 << 18  # words whose counts every task holds; the counts of the others are joined
DISCOUNT = 0.5  # taken off the count of a word outside the vocabulary, left to words that the corpus does not have
COUNT_BYTES = 32 << 20  # text that a task counts before it emits partial counts


def _keep_memory() -> None:
    """Lets the allocator keep freed memory for the next arrays, as glibc does up to the largest mapped block it has seen freed.

    Else the arrays of every step are mapped and given back, whose page faults cost more than its products.
    """
    np.empty(31 << 20, np.uint8)


def _word_counts(batches):
    _keep_memory()
    held, size = [], 0

    def flush():
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])
    for _, data, offsets in text_slices(batches):
        held.append(split_words(data, offsets)[0])
        size += len(data)
        if size >= COUNT_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the hash of every word of all documents and how often it occurs."""
    counted = texts(docs).select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counted, "word-counts")


def _columns(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.select("word", "n").toArrow()
    return got.column("word").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy().astype(np.int64)


def held_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of the most frequent words, at most HELD, and the count from which on words are held.

    The count is one of a logarithmic scale, so a word that is not held is
    about a HELD-th of all tokens at most: no join on it is skewed.
    """
    steps = (counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
             .orderBy(F.desc("step")).collect())
    least, words = 1 << 62, 0
    for r in steps:
        words += r["words"]
        if words > HELD:
            break
        least = r["least"]
    return *_columns(counts.filter(F.col("n") >= least)), least


@dataclass
class Lexicon:
    """What tasks know of words: token and log share of its token for each held word, and the log count of each hashed token."""

    words: np.ndarray  # sorted hashes
    token: np.ndarray
    share: np.ndarray  # log P(word | token); 0 for words with a token of their own
    others: np.ndarray

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token and log share of each word hash, and which words are not held: their share lacks the log of their count."""
        bucket = (h % np.uint64(OTHERS)).astype(np.int64)
        token, share, rare = WORDS + bucket, -self.others[bucket], np.ones(len(h), bool)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            known = self.words[at] == h
            token[known], share[known], rare[known] = self.token[at[known]], self.share[at[known]], False
        return token, share, rare


def lexicon(counts: DataFrame) -> tuple[Lexicon, int]:
    """The lexicon, and the count below which words are not held."""
    top, top_n = _columns(counts.orderBy(F.desc("n"), "word").limit(WORDS))
    held, held_n, least = held_words(counts)
    own = np.isin(held, top)
    held, held_n = held[~own], held_n[~own]
    total = np.zeros(OTHERS)
    for bucket, n in counts.groupBy(F.pmod("word", F.lit(OTHERS))).agg(F.sum("n")).collect():  # OTHERS divides 2 ** 64
        total[bucket] = n
    np.subtract.at(total, (top % np.uint64(OTHERS)).astype(np.int64), top_n)
    others = np.log(np.maximum(total, 1))
    bucket = (held % np.uint64(OTHERS)).astype(np.int64)
    words = np.concatenate([top, held])
    order = np.argsort(words)
    token = np.concatenate([np.arange(len(top)), WORDS + bucket])
    share = np.concatenate([np.zeros(len(top)), np.log(held_n - DISCOUNT) - others[bucket]])
    return Lexicon(words[order], token[order], share[order], others), least


def _encode(batches, known):
    _keep_memory()
    for rows, data, offsets in text_slices(batches):
        h, _, _, row = split_words(data, offsets)
        token, share, rare = known.look_up(h)
        ids, each = token.astype("<u2").tobytes(), np.arange(rows.num_rows + 1)
        ends = 2 * np.searchsorted(row, each)
        yield pa.RecordBatch.from_arrays([
            *rows.select(["doc_id", "k", "k2"]).columns, pa.array([ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
            pa.array(np.bincount(row, share, rows.num_rows).astype(np.float64)),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(row[rare], each).astype(np.int32)), pa.array(h[rare].view(np.int64)))],
            ["doc_id", "k", "k2", "ids", "share", "rare"])


class Network:
    SHAPES = {"embed": (VOCAB + 1, EMBED), "hidden": (2 * SIDE * EMBED, HIDDEN), "hidden_bias": (HIDDEN,), "classes": (HIDDEN, CLASSES),
              "class_bias": (CLASSES,), "tokens": (CLASSES, HIDDEN, CLASS), "token_bias": (CLASSES, CLASS)}

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at: at + n].reshape(shape))  # views of ``flat``
            at += n

    @classmethod
    def start(cls, seed: int = 1) -> "Network":
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES.values()), np.float32))
        net.embed[:] = rng.standard_normal(net.embed.shape) * 0.3
        net.hidden[:] = rng.standard_normal(net.hidden.shape) * (2 * SIDE * EMBED) ** -0.5
        return net

    def _top(self, around: np.ndarray):
        x = np.take(self.embed, around, 0).reshape(len(around), -1)
        h = x @ self.hidden
        h += self.hidden_bias
        return x, np.tanh(h, out=h)

    def _inside(self, h: np.ndarray, spans: list[tuple[int, int, int]], cls: np.ndarray) -> np.ndarray:
        """Scores of the tokens of each row's class, one column a row: products by class, all else over all rows at once."""
        z = np.empty((CLASS, len(h)), np.float32)
        for c, a, b in spans:
            np.matmul(self.tokens[c].T, h[a:b].T, out=z[:, a:b])
        z += np.take(self.token_bias.T.copy(), cls, 1)
        return z

    def log_probs(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log P(token | tokens around it), rows (left ..., right ...)."""
        order, around, cls, inside, spans = _by_class(around, token)
        h = self._top(around)[1]
        logs = _log_softmax_at(self.classes.T @ h.T + self.class_bias[:, None], cls)
        logs += _log_softmax_at(self._inside(h, spans, cls), inside)
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def step(self, around: np.ndarray, token: np.ndarray, rate: float) -> None:
        """One gradient step on the mean loss of a batch."""
        n = len(token)
        _, around, cls, inside, spans = _by_class(around, token)
        x, h = self._top(around)
        every = np.arange(n)
        d = _softmax(self.classes.T @ h.T + self.class_bias[:, None])
        d[cls, every] -= 1
        e = _softmax(self._inside(h, spans, cls))
        e[inside, every] -= 1
        dh, within = d.T @ self.classes.T, np.empty_like(h)
        scale = np.float32(rate / n)
        updates = [(self.classes, h.T @ d.T), (self.class_bias, d.sum(1))]
        for c, a, b in spans:
            np.matmul(e[:, a:b].T, self.tokens[c].T, out=within[a:b])
            grad = h[a:b].T @ e[:, a:b].T
            grad *= scale * CLASSES ** 0.5
            self.tokens[c] -= grad
        on = [c for c, _, _ in spans]
        self.token_bias[on] -= scale * CLASSES ** 0.5 * np.add.reduceat(e, [a for _, a, _ in spans], 1).T
        dh += within
        h *= h
        dpre = dh * np.subtract(1, h, out=h)
        dx = (dpre @ self.hidden.T).ravel()
        updates += [(self.hidden, x.T @ dpre), (self.hidden_bias, dpre.sum(0))]
        for value, grad in updates:
            value -= scale * grad
        cells = (around.reshape(-1, 1) * EMBED + np.arange(EMBED)).ravel()
        self.embed -= (scale * 8 * np.bincount(cells, dx, self.embed.size)).reshape(self.embed.shape)


def _by_class(around: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Rows put in the order of their token's class: the order, the rows, classes, places inside them, and (class, first, end) of each that has rows."""
    order = np.argsort((token // CLASS).astype(np.uint8), kind="stable")
    cls, inside = np.divmod(token[order], CLASS)
    ends = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    return order, np.take(around, order, 0), cls, inside, [(c, a, b) for c, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def _log_softmax_at(z: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The log softmax of each column at its place; overwrites z."""
    z -= z.max(0)
    chosen = z[place, np.arange(len(place))]
    return chosen - np.log(np.exp(z, out=z).sum(0))


def _around(ids: list[bytes], turn: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens around each token, the token, its row, its place in the row) of encoded documents; in a round, of its targets only."""
    n = np.array([len(b) // 2 for b in ids])
    row = np.repeat(np.arange(len(ids)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    token = np.frombuffer(b"".join(ids), "<u2").astype(np.int64)
    place = np.arange(len(token)) - first[row]
    padded = np.full(len(token) + 2 * SIDE * len(ids) + 2 * SIDE, VOCAB)
    at = np.arange(len(token)) + SIDE + 2 * SIDE * row  # every row has padding on both sides
    padded[at] = token
    if turn is not None:
        mine = _targets(place, turn)
        at, token, row, place = at[mine], token[mine], row[mine], place[mine]
    steps = [s for s in range(-SIDE, SIDE + 1) if s]
    return (np.stack([padded[at + s] for s in steps], 1) if len(token) else np.zeros((0, 2 * SIDE), np.int64)), token, row, place


def _targets(place: np.ndarray, turn: int) -> np.ndarray:
    """Which tokens, by their place in the document, the network learns in a round: each token in one of them."""
    return (place + turn) % ROUNDS == 0


def _train(batches, flat, turn):
    _keep_memory()
    net, seen = Network(flat.copy()), 0
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def learn(rows, last=False):
        around, token = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        mixed = np.random.default_rng(turn).permutation(len(token))
        for a in range(0, len(mixed), BATCH):
            part = mixed[a: a + BATCH]
            net.step(around[part], token[part], RATE * 0.5 ** turn * min(1.0, len(part) / 256))
        return len(token)
    size = 0
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            around, token, _, _ = _around(batch.column(0).slice(a, 1024).to_pylist(), turn)
            waiting.append((around, token))
            size += len(token)
            if size >= 32 * BATCH:
                seen += learn(waiting)
                waiting, size = [], 0
    if size:
        seen += learn(waiting)
    if seen:
        delta = (net.flat - flat).astype(np.float64) * seen
        place = np.append(np.flatnonzero(delta), len(delta))  # the last place counts tokens
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(np.append(delta, seen)[place])], ["place", "change"])


def train(spark: SparkSession, encoded: DataFrame) -> np.ndarray:
    flat = Network.start().flat
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(flat)
        changes = (encoded.select("ids").mapInArrow(lambda b, start=start, turn=turn: _train(b, start.value, turn), "place int, change double")
                   .groupBy("place").agg(F.sum("change").alias("change")).toArrow())
        place, change = changes.column("place").to_numpy(), changes.column("change").to_numpy()
        total = change[place == len(flat)]
        if not len(total):
            break
        own = place < len(flat)
        flat = flat.copy()
        flat[place[own]] += (change[own] / total[0]).astype(np.float32)
        start.unpersist()
    return flat


def _score(batches, flat):
    _keep_memory()
    net = Network(flat)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            around, token, row, _ = _around(part.column(2).to_pylist())
            logs = np.concatenate([net.log_probs(around[i: i + 8192], token[i: i + 8192]) for i in range(0, len(token), 8192)] or [np.zeros(0)]).astype(np.float64)
            n = np.bincount(row, minlength=part.num_rows)
            total = np.bincount(row, logs, part.num_rows) + part.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(total)], ["k", "k2", "n_tokens", "log_prob"])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob (summed) and mean_log_prob of every document."""
    spark = docs.sparkSession
    counts = word_counts(docs)
    words, least = lexicon(counts)
    known = spark.sparkContext.broadcast(words)
    keyed = texts(docs).withColumns({"k": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    encoded = keyed.mapInArrow(lambda b: _encode(b, known.value), "doc_id long, k long, k2 long, ids binary, share double, rare array<long>")
    encoded = materialise(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    flat = spark.sparkContext.broadcast(train(spark, encoded))
    # equal texts are scored once, as float products depend on the other rows of a batch
    contents = encoded.groupBy("k", "k2").agg(F.first(F.struct("ids", "share")).alias("one")).select("k", "k2", "one.ids", "one.share")
    scored = contents.mapInArrow(lambda b: _score(b, flat.value), "k long, k2 long, n_tokens long, log_prob double")
    scored = encoded.select("row", "doc_id", "k", "k2").join(scored, ["k", "k2"])
    # sums of whole numbers, so that they do not depend on the order of rows
    log_count = F.round(F.log(F.col("n") - F.lit(DISCOUNT)) * 2.0 ** 32).cast("long")
    rare = (encoded.select("row", F.explode("rare").alias("word")).join(counts.filter(F.col("n") < least), "word")
            .groupBy("row").agg((F.sum(log_count) / 2.0 ** 32).alias("rare")))
    whole = scored.join(rare, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("rare", F.lit(0.0)))
    return whole.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
