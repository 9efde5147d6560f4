"""Best-fit packing of tokenised documents by minimum bin slack.

Documents become token ids plus a closing id; longer ones are cut into pieces
of the sequence length. Only lengths matter for packing, so the bins are
planned on the histogram of piece lengths, which has at most ``capacity``
rows whatever the input. For one bin at a time a bitset subset-sum dynamic
programme over the available lengths (bit s: some choice of pieces sums to s)
finds the fullest feasible combination around the longest piece left; it is
removed, as often as the counts allow at once. The pieces are then numbered
within their length, in hash buckets so that a length that most pieces share
is still numbered in parallel, and look up their bin by that number.

Defined results: a null text is empty and packs as its closing id; repeated
rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.common import materialise, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Words whose ids a worker remembers; beyond it the cache starts anew (memory only, results do not change).
CACHE_WORDS = 800_000
# Pieces per numbering bucket.
BUCKET_PIECES = 10_000
# ASCII punctuation that ends a word after an ASCII letter: a token border, whatever the letters are.
# It begins with what it finds, so that the search runs from one mark to the next.
_TAIL = re.compile(rb"[!-/:-@\[-`{-~](?<=[a-z].)[!-/:-@\[-`{-~]*(?=[ \t-\r]|\Z)")
_STATE: dict = {}


def _encoder(path: str):
    """Tokenizer and word cache of this worker, kept between tasks."""
    if _STATE.get("path") != path:
        import os

        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _STATE.update(path=path, tokenizer=Tokenizer.from_file(path), cache={})
    return _STATE["tokenizer"], _STATE["cache"]


def _words(raw: bytes) -> list[bytes]:
    """Words and closing punctuation as they are looked up. Marks U+0300 to U+036F, the only ones
    that compose with ASCII letters, start with the byte CC or CD, which no other place of a character has."""
    if b"\xcc" not in raw and b"\xcd" not in raw:
        return _TAIL.sub(rb" \g<0>", raw.lower()).split()
    return [part for w in raw.split() for part in ([w] if b"\xcc" in w or b"\xcd" in w else _TAIL.sub(rb" \g<0>", w.lower()).split())]


def encode(texts_: list[str | None], path: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers.

    The vocabulary folds case and drops white space, and no token spans white
    space or the border of a letter and closing punctuation. So a text's ids
    are those of its ASCII-lowered words and their closing punctuation, which
    repeat and are remembered. A text that may hold a special token's name is
    encoded as it is, and so is a word with a combining mark: the vocabulary
    composes letters and marks before it folds case.
    """
    tokenizer, cache = _encoder(path)
    whole = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts_) if t and "<|" in t}
    split = [() if not t or i in whole else _words(t.encode()) for i, t in enumerate(texts_)]
    if len(cache) > CACHE_WORDS:
        cache.clear()
    found = [list(map(cache.get, words)) for words in split]  # one look-up a word
    gaps = [_gaps(ids) for ids in found]
    new = list({words[at] for words, places in zip(split, gaps, strict=True) for at in places})
    for at in range(0, len(new), 20_000):
        part = new[at: at + 20_000]
        for w, e in zip(part, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
            cache[w] = np.asarray(e.ids, "<u4").tobytes()
    for words, ids, places in zip(split, found, gaps, strict=True):
        for at in places:
            ids[at] = cache[words[at]]
    return [np.asarray(whole[i], "<u4").tobytes() if i in whole else b"".join(ids) for i, ids in enumerate(found)]


def _gaps(ids: list[bytes | None]) -> list[int]:
    """Places of the words that are not remembered."""
    out, at = [], -1
    try:
        while True:
            at = ids.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


def _cut(batches, path, capacity, end_id, with_ids):
    end = int(end_id).to_bytes(4, "little")
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            ids, cols = rows.column(0).to_pylist(), ([], [], [], [], [], [])
            for doc, raw in zip(ids, encode(rows.column(1).to_pylist(), path), strict=True):
                raw += end
                for piece, a in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[a: a + 4 * capacity]
                    for c, v in zip(cols, (doc, piece, a // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = np.frombuffer(b"".join(cols[5]), "<u4").astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *cols[3]]), pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` token ids."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return texts(docs).mapInArrow(lambda b: _cut(b, tokenizer_path, capacity, end_id, with_ids), schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The choice of available lengths with the largest sum up to capacity: length -> how many."""
    mask, reach, levels = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((n for n in counts if 0 < n <= capacity and counts[n]), reverse=True):
        levels.append((length, reach))
        left, step = min(counts[length], capacity // length), 1
        while left:  # as many as there are, in doubling steps
            step = min(step, left)
            reach |= (reach << (length * step)) & mask
            left -= step
            step *= 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(levels):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            chosen[length] = n
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack on a length histogram: (how many bins, [(length, pieces of it in each)])."""
    left, plan = {n: c for n, c in counts.items() if c}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        use = fullest(left, capacity - seed)
        left[seed] += 1
        use[seed] = use.get(seed, 0) + 1
        times = min(left[n] // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((times, sorted(use.items(), reverse=True)))
    return plan


def runs(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length, in order of piece number: (first number, first sequence, pieces in each, offset)."""
    out, given, sequence = {}, {}, 0
    for times, use in plan:
        offset = 0
        for length, k in use:
            first = given.get(length, 0)
            out.setdefault(length, []).append((first, sequence, k, offset))
            given[length] = first + k * times
            offset += length * k
        sequence += times
    return {n: np.array(v, np.int64) for n, v in out.items()}


def _place(frames, table):
    for f in frames:
        sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
        length, number = f["length"].to_numpy(), f.pop("_number").to_numpy()
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            run = table[int(n)][np.searchsorted(table[int(n)][:, 0], number[at], "right") - 1]
            q = number[at] - run[:, 0]
            sequence[at], offset[at] = run[:, 1] + q // run[:, 2], run[:, 3] + q % run[:, 2] * n
        yield f.assign(sequence_id=sequence, offset=offset)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece with the sequence it goes to and its place there, gapless from 0."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    if not histogram:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    table = spark.sparkContext.broadcast(runs(plan_bins(histogram, capacity)))
    buckets = -(-sum(histogram.values()) // BUCKET_PIECES)
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_bucket").count().select(
        "length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (dealt.withColumn("_rank", F.row_number().over(within)).join(starts, ["length", "_bucket"])
                .select(*cut.columns, (F.col("_start") + F.col("_rank") - 1).alias("_number")))
    schema = numbered.drop("_number").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInPandas(lambda f: _place(f, table.value), schema)
