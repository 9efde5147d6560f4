"""Substring dedup: maximal repeats from prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document. Suffixes that start
a window are grouped by a word prefix that all equal windows share at the same
place: the window's anchor, the smallest-hashed ``ANCHOR``-word run in it.
Neighbouring starts mostly share their anchor, so a group's entry is a stretch
of text with a short range of starts, not one row per suffix, and anchors that
occur once need no further work.

* Groups whose stretches are all equal need no tree: every start repeats.
* Groups of at most ``GROUP`` different stretches get a suffix tree of their
  suffixes (sorted by prefix doubling, internal nodes as runs of a common
  prefix): the leaves below an internal node of depth ``WINDOW`` repeat.
* In larger groups the prefix is lengthened to the whole window, one row per
  suffix: a group is then one path, and counting replaces the tree. So no
  group that reaches a task grows with the data.

All counting is on the input texts. A document's repeated starts then mark the
words that they cover, and those are removed.

Defined results: null and empty texts have no words and nothing removed;
repeated rows repeat each other; texts of fewer than ``WINDOW`` words keep
everything; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import discard, gram_hashes, materialise, mix64, multipliers, row_key, split_words, text_slices, texts

WINDOW = 35
ANCHOR = 8
# Different stretches in a tree: about 1 kB each while it is built (50 words, as ranks, pairs and sort order).
GROUP = 20_000
TREE_BATCH = 2000  # stretches of small groups that share a task's frame
_ROOT = int(multipliers(600)[599])


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest (leftmost on ties) of x[i : i + w], for every i; by doubling."""
    n = len(x) - w + 1
    best, size = np.arange(len(x)), 1
    while size < w:
        step = min(size, w - size)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(x[right] < x[left], right, left)
        size += step
    return best[:n]


def stretches(data: np.ndarray, offsets: np.ndarray):
    """Anchored stretches of the texts end to end in ``data``.

    Returns (row, anchor hash, first start, last start, stretch hash, starts
    of words, ends of words, first word of each row): starts are word places
    in the row; the stretch is the words first .. last + WINDOW - 1, and its
    hash also holds where the anchor lies in it.
    """
    h, a, b, row = split_words(data, offsets)
    first = np.searchsorted(row, np.arange(len(offsets)))
    n = len(h) - WINDOW + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, np.zeros(0, np.uint64), empty, empty, np.zeros(0, np.uint64), a, b, first
    g, _ = gram_hashes(h, row, ANCHOR)
    at = sliding_argmin(g, WINDOW - ANCHOR + 1)
    ok = np.flatnonzero(row[:n] == row[WINDOW - 1:])
    if not len(ok):
        return empty, np.zeros(0, np.uint64), empty, empty, np.zeros(0, np.uint64), a, b, first
    anchor = at[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[ok][1:] != row[ok][:-1])
    lo = ok[new]
    hi = np.append(ok[np.flatnonzero(new)[1:] - 1], ok[-1])
    p = anchor[new]
    # polynomial prefix sums give the hash of any stretch
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), _ROOT, np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[:-1])])
    span = sums[hi + WINDOW] - sums[lo]
    inverse = np.uint64(pow(_ROOT, -1, 1 << 64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), inverse, np.uint64)]))
    whole = mix64(mix64(span * back[lo] + (hi - lo).astype(np.uint64)) + (p - lo).astype(np.uint64))
    r = row[lo]
    return r, g[p], lo - first[r], hi - first[r], whole, a, b, first


def _anchors(batches):
    for rows, data, offsets in text_slices(batches):
        r, g, lo, hi, whole, *_ = stretches(data, offsets)
        key = rows.column(0).take(pa.array(r))
        yield pa.RecordBatch.from_arrays([key, pa.array(g.view(np.int64)), pa.array(whole.view(np.int64)), pa.array((lo << 8) | (hi - lo))], ["_key", "anchor", "stretch", "at"])


def _texts_of(frames):
    """The stretches of a document that are listed in ``wanted``: with text."""
    for f in frames:
        for at in range(0, len(f), 64):
            part = f.iloc[at: at + 64]
            raw = [(t or "").encode() for t in part["text"]]
            data = np.frombuffer(b"".join(raw), np.uint8)
            r, g, lo, hi, whole, a, b, first = stretches(data, np.cumsum([0, *map(len, raw)]))
            need = [set(x.tolist()) for x in part["wanted"]]
            place, blob, out = (lo << 8) | (hi - lo), data.tobytes(), []
            for i in range(len(r)):
                if int(place[i]) in need[r[i]]:
                    base = int(first[r[i]])
                    piece = blob[int(a[base + lo[i]]): int(b[base + hi[i] + WINDOW - 1])]
                    out.append((int(g[i].view(np.int64)), int(whole[i].view(np.int64)), int(hi[i] - lo[i]), b" ".join(piece.split()).decode()))
            yield pd.DataFrame(out, columns=["anchor", "stretch", "more", "words"])


def window_ranks(words: np.ndarray) -> np.ndarray:
    """Rank of the WINDOW words from each place on, in sorted order: suffix sorting by prefix doubling.

    Ranks of runs twice as long come from pairs of ranks; suffixes of equal
    rank share a path of WINDOW words.
    """
    rank, size = np.unique(words, return_inverse=True)[1], 1
    while size < WINDOW and len(rank):
        step = min(size, WINDOW - size)
        rank = np.unique(rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        size += step
    return rank


def repeated_suffixes(entries: list[tuple[list[str], int, int]]) -> list[int]:
    """Bit masks of the starts whose window repeats, one mask per entry (words, starts - 1, copies).

    The suffix tree of all suffixes that start a window, as far as it matters:
    suffixes in sorted order, whose internal nodes at depth WINDOW are the
    runs of suffixes with a common prefix that long. The leaves below a node
    with two leaves or more repeat.
    """
    name: dict[str, int] = {}
    words = np.array([name.setdefault(w, len(name)) for e in entries for w in e[0]], np.int64)
    rank = window_ranks(words)
    starts = np.array([e[1] + 1 for e in entries])
    first = np.cumsum([0, *(len(e[0]) for e in entries[:-1])])
    entry = np.repeat(np.arange(len(entries)), starts)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(starts) - starts, starts)
    node = rank[first[entry] + place]
    leaves = np.bincount(node, np.array([e[2] for e in entries])[entry])
    deep = leaves[node] > 1
    masks = np.zeros(len(entries), np.int64)
    np.bitwise_or.at(masks, entry[deep], np.int64(1) << place[deep])
    return masks.tolist()


def _trees(pdf: pd.DataFrame) -> pd.DataFrame:
    """All groups of a task at once: windows of different groups differ in their anchor, so no path joins them."""
    entries = [(w.split(" "), m, c) for w, m, c in zip(pdf["words"], pdf["more"].tolist(), pdf["copies"].tolist(), strict=True)]
    out = pdf[["anchor", "stretch"]].assign(mask=np.array(repeated_suffixes(entries), np.int64))
    return out[out["mask"] != 0]


def _windows(frames):
    """One row per suffix of an entry of a large group, by a 128-bit name of its whole window."""
    for f in frames:
        out = []
        for anchor, stretch, more, words, copies in f[["anchor", "stretch", "more", "words", "copies"]].itertuples(index=False):
            w = words.split(" ")
            for s in range(more + 1):
                out.append((hashlib.blake2b("\x00".join(w[s: s + WINDOW]).encode(), digest_size=16).digest(), anchor, stretch, s, copies))
        yield pd.DataFrame(out, columns=["name", "anchor", "stretch", "start", "copies"])


def _remove(frames):
    for f in frames:
        ids, n_words, n_removed, digest, kept_texts = f["doc_id"], [], [], [], []
        for text, runs in zip(f["text"], f["runs"], strict=True):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for run, mask in ((r["at"], r["mask"]) for r in runs) if runs is not None else ():
                lo, more = run >> 8, run & 255
                if mask < 0:  # every start of the run
                    gone[lo] += 1
                    gone[lo + more + WINDOW] -= 1
                    continue
                for s in range(more + 1):
                    if mask >> s & 1:
                        gone[lo + s] += 1
                        gone[lo + s + WINDOW] -= 1
            stay = np.cumsum(gone)[: len(words)] == 0
            kept = b" ".join(w for w, k in zip(words, stay.tolist(), strict=True) if k) if not stay.all() else b" ".join(words)
            n_words.append(len(words))
            n_removed.append(int(len(words) - stay.sum()))
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode())
        yield pd.DataFrame({"doc_id": ids.astype("Int64"), "n_words": n_words, "n_removed": n_removed, "kept_sha256": digest, "kept_text": kept_texts})


def repeated_starts(docs_keyed: DataFrame) -> DataFrame:
    """(_key, at, mask): runs of starts (first << 8 | starts - 1) and which of them repeat, as bits; -1: all."""
    anchors = docs_keyed.select("_key", "text").mapInArrow(_anchors, "_key long, anchor long, stretch long, at long")
    anchors = materialise(anchors, "anchors")
    # written first, so that the join reads plain shuffles and Spark can split a hot anchor
    often = (anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("stretch").alias("least"), F.max("stretch").alias("most"))
             .filter("n > 1").select("anchor", (F.col("least") == F.col("most")).alias("same")))
    often = materialise(often, "often")
    again = materialise(anchors.join(often, "anchor"), "again")
    discard(anchors)
    discard(often)
    plain = again.filter("same").select("_key", "at", F.lit(-1).cast("long").alias("mask"))
    mixed = again.filter("not same").drop("same")
    wanted = mixed.groupBy("_key").agg(F.collect_set("at").alias("wanted"))
    entries = docs_keyed.join(wanted, "_key").select("text", "wanted").mapInPandas(_texts_of, "anchor long, stretch long, more int, words string")
    # copies of equal stretches are counted over rows, as equal rows share a key
    copies = mixed.groupBy("anchor", "stretch").agg(F.count("*").alias("copies"))
    # a document may hold a stretch twice and share its key with equal rows: one text each is enough
    entries = entries.groupBy("anchor", "stretch", "more", "words").agg(F.lit(1).alias("one")).drop("one").join(copies, ["anchor", "stretch"])
    sizes = copies.groupBy("anchor").agg(F.count("*").alias("size"))
    sized = materialise(entries.join(sizes, "anchor"), "stretches")
    tasks = max(1, sized.filter(F.col("size") <= GROUP).count() // TREE_BATCH)
    masks = (sized.filter(F.col("size") <= GROUP).withColumn("task", F.pmod(F.xxhash64("anchor"), F.lit(tasks)))
             .groupBy("task").applyInPandas(_trees, "anchor long, stretch long, mask long"))
    leaves = sized.filter(F.col("size") > GROUP).mapInPandas(_windows, "name binary, anchor long, stretch long, start int, copies long")
    counted = leaves.groupBy("name").agg(F.sum("copies").alias("all")).filter(F.col("all") > 1)
    large = (leaves.join(counted, "name").groupBy("anchor", "stretch")
             .agg(F.bit_or(F.expr("shiftleft(1L, start)")).alias("mask")))
    return plain.union(mixed.join(masks.union(large), ["anchor", "stretch"]).select("_key", "at", "mask"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every document."""
    keyed = row_key(texts(docs))
    runs = repeated_starts(keyed).groupBy("_key").agg(F.collect_set(F.struct("at", "mask")).alias("runs"))
    return keyed.join(runs, "_key", "left").select("doc_id", "text", "runs").mapInPandas(
        _remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
