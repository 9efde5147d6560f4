"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its five-word shingles (a text of one to four words
is one shingle). Documents with equal sets are one class, found by a 128-bit
set fingerprint, so copies cost nothing further. MinHash bands link classes
that may be alike: ``BANDS`` bands of ``ROWS`` values miss a pair at the
threshold with probability (1 - 0.8 ** ROWS) ** BANDS, about 5e-6. Bands only
make star edges (each class to the smallest of its bucket), whose connected
components hold every candidate pair. Within a component pairs are compared in
blocks of at most ``BLOCK`` classes on either side: MinHash values are read a
few at a time, a pair is dropped as soon as the posterior probability (uniform
prior, Beta posterior) of reaching the threshold falls below ``TOLERANCE``,
and the rest is verified on the exact shingle sets. A block returns one row
per class (how many documents it links to, and a spanning forest), so a group
of g near copies makes about g * g / BLOCK rows, never a row per pair.

Defined results: texts without words (null, empty) are linked to nothing, not
even to each other, and are their own class; repeated rows are copies of one
another; empty tables give no rows.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import carried, discard, gram_hashes, materialise, mix64, multipliers, row_key, split_words, text_slices, texts
from retentia.llm.components import components

SHINGLE = 5
ROWS, BANDS = 6, 40
BLOCK = 256
STEP = 24  # MinHash values compared at a time
TOLERANCE = 1e-9


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts that lie end to end in ``data``: (row, shingle), sorted."""
    h, _, _, row = split_words(data, offsets)
    g, whole = gram_hashes(h, row, SHINGLE)
    n = np.bincount(row, minlength=len(offsets) - 1)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    rows, shingles = [row[:len(g)][whole]], [g[whole]]
    first = np.searchsorted(row, few)
    for r, a in zip(few.tolist(), first.tolist(), strict=True):
        rows.append(np.array([r]))
        shingles.append(mix64(np.add.reduce(h[a: a + n[r]] * multipliers(512)[200: 200 + n[r]], keepdims=True) + np.uint64(n[r])))
    rows, shingles = np.concatenate(rows), np.concatenate(shingles)
    order = np.lexsort((shingles, rows))
    rows, shingles = rows[order], shingles[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (shingles[1:] != shingles[:-1])
    return rows[new], shingles[new]


def minhashes(shingles: np.ndarray, starts: np.ndarray, lo: int = 0, hi: int = ROWS * BANDS) -> np.ndarray:
    """MinHash values lo..hi of each set (sets start at ``starts``), one row a hash function."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    keys = multipliers(1024)[512: 512 + ROWS * BANDS]
    out = np.empty((hi - lo, len(starts)), np.uint32)
    for i in range(lo, hi):
        out[i - lo] = np.minimum.reduceat((x ^ np.uint32(int(keys[i]) & 0xFFFFFFFF)) * np.uint32(int(keys[i]) >> 32 | 1), starts)
    return out


def _sign(batches):
    band_key = multipliers(512)[300: 300 + BANDS]
    for rows, data, offsets in text_slices(batches):
        row, sh = shingle_sets(data, offsets)
        n = rows.num_rows
        at, starts = np.unique(row, return_index=True)
        cls, size = np.zeros(n, np.int64), np.zeros(n, np.int32)
        lists = np.zeros((n, BANDS), np.int64)
        if len(at):
            total = np.add.reduceat(mix64(sh), starts)
            other = np.bitwise_xor.reduceat(mix64(sh + np.uint64(1)), starts)
            count = np.diff(starts, append=len(sh))
            cls[at] = mix64(total ^ mix64(other + count.astype(np.uint64))).view(np.int64)
            size[at] = count
            m = minhashes(sh, starts).astype(np.uint64)
            mult = multipliers(512)[400: 400 + ROWS]
            for b in range(BANDS):
                lists[at, b] = mix64((m[b * ROWS: (b + 1) * ROWS] * mult[:, None]).sum(0, dtype=np.uint64) ^ band_key[b]).view(np.int64)
        has = size > 0
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32()), pa.array(lists[has].ravel()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(cls), pa.array(size), bands], ["_key", "doc_id", "cls", "n_shingles", "bands"])


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest matches of n with which a pair still may reach the threshold.

    With a uniform prior the similarity given m of n matches is Beta(m + 1,
    n - m + 1); its mass above t is the chance of at most m successes in n + 1
    trials of probability t.
    """
    out = []
    for n in range(STEP, ROWS * BANDS + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def similar_pairs(row: np.ndarray, sh: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, threshold: float, least: list[int]) -> np.ndarray:
    """Which of the pairs (a, b) of n non-empty sets reach the threshold."""
    starts = np.searchsorted(row, np.arange(n))
    size = np.diff(starts, append=len(sh))
    alive = np.flatnonzero(np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9)
    same = np.zeros(len(alive), np.int32)
    for k, need in enumerate(least):
        if not len(alive):
            break
        m = minhashes(sh, starts, k * STEP, (k + 1) * STEP)
        x, y = a[alive], b[alive]
        for values in m:
            same += values[x] == values[y]
        keep = same >= need
        alive, same = alive[keep], same[keep]
    # exact: common shingles by products of 0/1 matrices over the shingles that two sets share, a band of columns at a time
    used = np.unique(np.concatenate([a[alive], b[alive]]))
    index = np.full(n, -1)
    index[used] = np.arange(len(used))
    mine = index[row] >= 0
    r, s = index[row[mine]], sh[mine]
    order = np.argsort(s, kind="stable")
    r, s = r[order], s[order]
    column = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
    shared = np.bincount(column, minlength=1)[column] > 1 if len(s) else np.zeros(0, bool)
    r, column = r[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    common, width = np.zeros((len(used), len(used)), np.float64), 4096
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [lo, lo + width]))
        x = np.zeros((len(used), width), np.float32)
        x[r[part], column[part] - lo] = 1
        common += x @ x.T
    x, y = a[alive], b[alive]
    inter = common[index[x], index[y]]
    out = np.zeros(len(a), bool)
    out[alive] = inter >= threshold * (size[x] + size[y] - inter) - 1e-9
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block_links(pdf: pd.DataFrame, threshold: float, least: list[int]) -> pd.DataFrame:
    """Links in one group of blocks: class, documents that it links to, smallest linked class of its tree."""
    out = []
    for _, part in pdf.groupby("component", sort=False):
        part = part.sort_values("cls", kind="stable").reset_index(drop=True)
        raw = [t.encode() for t in part["text"]]
        row, sh = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        n, block = len(part), part["block"].to_numpy()
        a, b = np.triu_indices(n, 1)
        if part["low"].iloc[0] != part["high"].iloc[0]:  # two blocks: pairs between them only
            cross = block[a] != block[b]
            a, b = a[cross], b[cross]
        linked = similar_pairs(row, sh, n, a, b, threshold, least)
        a, b = a[linked], b[linked]
        weight = part["weight"].to_numpy()
        links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        root = _roots(n, a, b)
        got = links > 0
        cls = part["cls"].to_numpy()
        out.append(pd.DataFrame({"cls": cls[got], "links": links[got].astype(np.int64), "root": cls[root[got]]}))
    return pd.concat(out) if out else pd.DataFrame({"cls": [], "links": [], "root": []}).astype("int64")


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(_key, doc_id, n_shingles, near, n_links) of every document.

    ``near`` is the same for documents that links connect; ``n_links`` counts
    the other documents whose shingle sets reach the threshold.
    """
    keyed = row_key(texts(docs))
    signed = materialise(keyed.select("_key", "doc_id", "text").mapInArrow(_sign, "_key long, doc_id long, cls long, n_shingles int, bands array<long>"), "signed")
    some = signed.filter("n_shingles > 0")
    classes = materialise(some.groupBy("cls").agg(F.count("*").alias("weight"), F.min("_key").alias("_key"), F.first("bands").alias("bands")), "classes")
    rows = classes.select("cls", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).filter("first < last").select("band", "first")
    buckets = materialise(buckets, "buckets")  # so that the join reads plain shuffles and Spark can split a hot bucket
    stars = rows.join(buckets, "band").filter("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b")).distinct()
    candidates = components(stars)
    members = materialise(candidates.join(classes, F.col("node") == F.col("cls")).select("cls", "component", "weight", "_key"), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    groups = max(1, members.count() // BLOCK)
    blocked = (members.join(sizes, "component").withColumn("n_blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
               .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int")))
    # always by shuffle: the members are a share of the corpus, whatever their size here
    texts_ = keyed.select("_key", "text").join(blocked.hint("merge"), "_key").dropDuplicates(["cls"])
    tasks = texts_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "component", "cls", "weight", "text", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(
            F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other"))).alias("task"))
    least = least_matches(threshold)
    found = materialise(tasks.groupBy("task").applyInPandas(lambda g: _block_links(g, threshold, least), "cls long, links long, root long"), "links")
    near = components(found.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    facts = (classes.join(links, "cls", "left").join(near.withColumnRenamed("node", "cls"), "cls", "left")
             .select("cls", "weight", "links", F.coalesce("component", "cls").alias("near")))
    out = signed.select("_key", "doc_id", "n_shingles", "cls").join(facts, "cls", "left")
    discard(members)
    return out.select("_key", "doc_id", "n_shingles", F.coalesce("near", F.xxhash64(F.lit(11), "_key")).alias("near"),
                      (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def jaccard_join(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the smallest id that links connect it to) and n_links of every document."""
    near = materialise(near_classes(docs, threshold), "near")
    named = near.groupBy("near").agg(F.min("doc_id").alias("class_id"))
    return near.join(named, "near").select("doc_id", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_links", "n_shingles")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents with one of each class (the smallest id) kept, all columns."""
    near = materialise(near_classes(docs, threshold), "near")
    first = near.groupBy("near").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first"))
    winners = first.select(F.col("first._key").alias("_key")).union(near.filter("n_shingles = 0").select("_key")).distinct()
    kept = carried(docs).join(winners, "_key").withColumn("_bare", ~F.coalesce("text", F.lit("")).rlike("[^ \t-\r]"))
    return kept.filter("not _bare").dropDuplicates(["_key"]).unionByName(kept.filter("_bare")).select("_row.*")
