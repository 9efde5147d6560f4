"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII bytes, ASCII lower-cased, so
case and punctuation do not hide a leak. Test items whose word seeds
(``min_tile`` words) occur in a document are joined to it by seed; an item
whose words under shared seeds fall short of the threshold cannot reach it
and is dropped (no tile can use other words). For the rest the longest
common runs are found with Karp-Rabin window hashes, marked, and searched
again among the unmarked words with ever shorter windows, down to
``min_tile``: reordered passages are covered by several tiles. A pair is
returned when tiles cover ``threshold`` of the item's words.

The test items are a query set that is compared in blocks of at most
``block_words`` words (that bounds what is broadcast); every block meets every
document whole, in one scan a block without a shuffle. An item of fewer than
``min_tile`` words is found where all its words occur in a row.

Defined results: null and empty texts, and items without a word, are in no
pair; repeated documents or items give repeated pairs; empty
tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import carried, gram_hashes, row_key, split_words, text_slices, texts

SCHEMA = ("doc_id long, item_id long, n_tiles int, matched_words int, item_words int, coverage double, "
          "tiles array<struct<doc_word:int,item_word:int,n_words:int>>")
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tiles", pa.int32()), ("matched_words", pa.int32()),
                    ("item_words", pa.int32()), ("coverage", pa.float64()),
                    ("tiles", pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())])))])

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, row = split_words(_FOLD[data], offsets, _PUNCT)
    return h, row


def _windows(words: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(place, Karp-Rabin hash) of every window of unmarked words."""
    top, h, run = pow(_BASE, size - 1, _MOD), 0, 0
    for i, w in enumerate(words):
        if not free[i]:
            h = run = 0
            continue
        if run >= size:
            h = (h - words[i - size] * top) % _MOD
        h = (h * _BASE + w) % _MOD
        run += 1
        if run >= size:
            yield i - size + 1, h


def tile(doc: list[int], item: list[int], doc_free: list[bool], min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of the item with the document's free words: (doc place, item place, length)."""
    doc_free, item_free, tiles = list(doc_free), [True] * len(item), []
    size = max(min_tile, len(item))
    while True:
        seen = defaultdict(list)
        for i, h in _windows(item, item_free, size):
            seen[h].append(i)
        matches = []
        for j, h in _windows(doc, doc_free, size):
            for i in seen.get(h, ()):
                if i and j and item_free[i - 1] and doc_free[j - 1] and item[i - 1] == doc[j - 1]:
                    continue  # part of a longer match that starts earlier
                n = 0
                while i + n < len(item) and j + n < len(doc) and item_free[i + n] and doc_free[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n >= size:
                    matches.append((-n, j, i))
        if not matches and size == min_tile:
            return tiles
        marked = False
        for n, j, i in sorted(matches):
            if all(item_free[i: i - n]) and all(doc_free[j: j - n]):
                tiles.append((j, i, -n))
                item_free[i: i - n] = doc_free[j: j - n] = [False] * -n
                marked = True
        if not marked:  # what overlapped a longer tile is searched again, shorter
            size = max(min_tile, size // 2)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items' word hashes, in blocks; streams the table, never holds more than a block."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        data = np.frombuffer((r[1] or "").encode(), np.uint8)
        h, _ = word_hashes(data, np.array([0, len(data)]))
        if not len(h):
            continue
        if block and size + len(h) > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], h))
        size += len(h)
    if block:
        yield block


class _Index:
    """Seeds of a block's items: sorted hashes, and the item and place of each."""

    def __init__(self, block, k):
        self.items = [h for _, h in block]
        self.ids = [i for i, _ in block]
        seeds = [gram_hashes(h, np.zeros(len(h), np.int8), k)[0] for h in self.items]
        order = np.argsort(flat := np.concatenate(seeds), kind="stable")
        self.seed = flat[order]
        self.item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])[order]
        self.place = np.concatenate([np.arange(len(s)) for s in seeds])[order]


def _indexes(block, min_tile: int) -> list[tuple[int, _Index]]:
    """(seed words, index): items of fewer than ``min_tile`` words have an index of their length, so that they match whole."""
    by_seed = defaultdict(list)
    for item in block:
        by_seed[min(min_tile, len(item[1]))].append(item)
    return [(k, _Index(items, k)) for k, items in sorted(by_seed.items())]


def _scan(batches, indexes: list[tuple[int, _Index]], threshold: float):
    for rows, data, offsets in text_slices(batches):
        ids = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
        h, row = word_hashes(data, offsets)
        for k, index in indexes:
            yield from _matches(ids, h, row, index, k, threshold)


def _matches(ids: list, h: np.ndarray, row: np.ndarray, index: _Index, k: int, threshold: float):
    g, whole = gram_hashes(h, row, k)
    lo = np.searchsorted(index.seed, g)
    hit = np.flatnonzero(whole & (index.seed[np.minimum(lo, len(index.seed) - 1)] == g))
    if not len(hit):
        return
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    out = []
    for part in np.split(hit, np.flatnonzero(np.diff(row[hit])) + 1):
        r = int(row[part[0]])
        base = int(first[r])
        shared, islands = defaultdict(set), defaultdict(set)
        for p in part.tolist():
            a = int(lo[p])
            while a < len(index.seed) and index.seed[a] == g[p]:
                shared[int(index.item[a])].update(range(int(index.place[a]), int(index.place[a]) + k))
                islands[int(index.item[a])].update(range(p, p + k))
                a += 1
        words = None
        for it, covered in shared.items():
            item = index.items[it]
            if len(covered) < threshold * len(item):
                continue
            if words is None:
                words = h[base: int(first[r + 1])].tolist()
            free = np.zeros(len(words), bool)
            free[np.fromiter(islands[it], int) - base] = True
            tiles = tile(words, item.tolist(), free.tolist(), k)
            matched = sum(t[2] for t in tiles)
            if matched >= threshold * len(item):
                out.append({"doc_id": ids[r], "item_id": index.ids[it], "n_tiles": len(tiles), "matched_words": matched,
                            "item_words": len(item), "coverage": matched / len(item),
                            "tiles": [{"doc_word": j, "item_word": i, "n_words": n} for j, i, n in sorted(tiles)]})
    if out:
        yield pa.RecordBatch.from_pylist(out, _ARROW)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tile: int = 4, threshold: float = 0.5,
                 block_words: int = 1_000_000, id_col: str = "doc_id") -> DataFrame:
    """Pairs of a document and a test item that it covers to ``threshold`` or more."""
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, block_words):
        indexes = sc.broadcast(_indexes(block, min_tile))
        part = source.mapInArrow(lambda b, indexes=indexes: _scan(b, indexes.value, threshold), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that cover no test item, with all their columns."""
    flagged = contaminated(row_key(texts(docs)), benchmark, id_col="_key", **options)
    return carried(docs).join(flagged.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select("_row.*")
