"""Alignment of two tokenizers' tokens and how common each aligned pair of ids is.

A text is cut into segments, a run of white space and the word after it, at
places where both tokenizers always have a border: before a space that
follows another character than white space. So a text's tokens are its
segments' tokens, segments repeat, and each is encoded and aligned once and
remembered. The rule needs a word-split byte-level vocabulary (A) and a
piece vocabulary without a space after another character (B); ``_Segments`` checks it.

Documents are numbered in buckets of bounded text. For each bucket an
inverted index has one posting per pair of ids: multiplicity planes, where
plane k is the compressed bitmap of the documents in which bit k of the
pair's number of links is set. The OR of the planes is the pair's document
bitmap; its popcount, summed over buckets (they have no document in common),
is the pair's document count. The counts then return along the postings: each
bucket reads its planes once more and adds, to each document, count times multiplicity.

Defined results: null and empty texts, and texts whose tokens do not give the
text back (in A or in B), have no tokens and zeros; each repeated row is a
document of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.common import materialise, texts

# Text and documents of a bucket; the text of a step of it. Positions in a bucket are 16 bits.
BUCKET_CHARS = 8 << 20
BUCKET_DOCS = 60_000
STEP_CHARS = 1 << 20
# Segments a worker remembers, and their characters; beyond it the memory starts anew (results do not change).
REMEMBER = 400_000
REMEMBER_CHARS = 24 << 20
_SEGMENT = re.compile(r" [^ ]*(?:(?<!\S) [^ ]*)*")
_STATE: dict = {}

INDEX = ("bucket long, pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "pair long, n_docs long, planes array<binary>")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_level() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: itself if printable, else the next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


class _Segments:
    """The segments that a worker has met: their numbers, token counts, links and groups."""

    def __init__(self, path_a: str, path_b: str):
        import os

        import sentencepiece
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_level()
        self.bytes_a = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [_piece_bytes(p, self.b.is_byte(i)) for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the piece vocabulary has a space after another character: segments are not independent")
        self.space = self.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes: list[tuple[int, int, int, int]] = []  # tokens of A, of B, groups, links; tokens of A are -1 if the bytes differ
        self.links: list[np.ndarray] = []
        self.chars = 0

    def learn(self, new: list[str]) -> None:
        """Encodes and aligns segments that are new."""
        in_a = self.a.encode_batch_fast(new, add_special_tokens=False)
        in_b = self.b.encode([s[1:] for s in new], num_threads=1)
        bytes_a, bytes_b, pairs = self.bytes_a, self.bytes_b, []
        for s, ea, ids_b in zip(new, in_a, in_b, strict=True):
            ids_a = ea.ids
            if s == " ":
                ids_b = [self.space]
            part_a, part_b = [bytes_a[i] for i in ids_a], [bytes_b[i] for i in ids_b]
            self.number[s] = len(self.groups)
            self.chars += len(s)
            if not b"".join(part_a) == b"".join(part_b) == s.encode():
                self.groups.append("")
                self.sizes.append((-1, 0, 0, 0))
                continue
            before, groups, i, j, end_a, end_b, from_a, from_b = len(pairs), [], 0, 0, len(part_a[0]), len(part_b[0]), 0, 0
            while True:
                pairs.append(ids_a[i] << 32 | ids_b[j])
                if end_a == end_b:
                    i, j = i + 1, j + 1
                    groups.append(f"{','.join(map(str, ids_a[from_a:i]))}|{','.join(map(str, ids_b[from_b:j]))}")
                    if i == len(ids_a):
                        break
                    from_a, from_b = i, j
                    end_a, end_b = end_a + len(part_a[i]), end_b + len(part_b[j])
                elif end_a < end_b:
                    i += 1
                    end_a += len(part_a[i])
                else:
                    j += 1
                    end_b += len(part_b[j])
            self.groups.append(";".join(groups))
            self.sizes.append((len(ids_a), len(ids_b), len(groups), len(pairs) - before))
        self.links.append(np.array(pairs, np.int64))


def _segments(path_a: str, path_b: str) -> _Segments:
    """The worker's segments, kept between tasks."""
    if _STATE.get("paths") != (path_a, path_b):
        _STATE.update(paths=(path_a, path_b), segments=_Segments(path_a, path_b))
    return _STATE["segments"]


def pack_planes(pair: np.ndarray, pos: np.ndarray, times: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pairs, document counts, planes) from distinct (pair, pos) sorted by both.

    A plane is the smaller of its positions as 16-bit numbers (an even number
    of bytes) and a bitmap over the bucket (an odd number of bytes).
    """
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first)), np.diff(first, append=len(pair)))
    top = np.maximum.reduceat(times, first) if len(first) else times[:0]
    n_planes = np.zeros(len(first), np.int64)
    while (over := top >> n_planes > 0).any():
        n_planes += over
    slot_of = np.concatenate([[0], np.cumsum(n_planes)])
    parts = [(slot_of[owner[on]] + k, pos[on]) for k in range(int(n_planes.max(initial=0))) if len(on := np.flatnonzero(times >> k & 1))]
    slot = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    place = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(slot, kind="stable")
    slot, place = slot[order], place[order]
    held = np.bincount(slot, minlength=slot_of[-1])
    start = np.cumsum(held) - held
    bitmap_bytes = -(-n_docs // 8) | 1
    dense = 2 * held > bitmap_bytes
    size = np.where(dense, bitmap_bytes, 2 * held)
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(at[-1], np.uint8)
    listed = ~dense[slot]
    to = at[slot[listed]] + 2 * (np.arange(len(slot))[listed] - start[slot[listed]])
    data[to], data[to + 1] = place[listed] & 255, place[listed] >> 8
    for s in np.flatnonzero(dense):
        bits = np.zeros(bitmap_bytes * 8, np.uint8)
        bits[place[start[s]: start[s] + held[s]]] = 1
        data[at[s]: at[s + 1]] = np.packbits(bits)
    planes = pa.ListArray.from_arrays(pa.array(slot_of, pa.int32()), pa.BinaryArray.from_buffers(
        pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]))
    # the OR of a pair's planes has each of its documents once
    return pair[first], np.diff(first, append=len(pair)), planes


def unpack_planes(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, 2 ** plane) of every set bit."""
    offsets = np.asarray(planes.offsets).astype(np.int64)
    flat = planes.flatten()
    row = np.repeat(np.arange(len(planes)), np.diff(offsets))
    weight = np.int64(1) << (np.arange(len(flat)) - (offsets[:-1] - offsets[0])[row])
    at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset: flat.offset + len(flat) + 1].astype(np.int64)
    data = np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) and flat.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(at)
    listed = size % 2 == 0
    held = np.where(listed, size // 2, 0)
    body = data[at[0]: at[-1]] if len(at) else data
    raw = body[np.repeat(listed, size)].astype(np.int64)
    rows, places, weights = [np.repeat(row, held)], [raw[::2] | raw[1::2] << 8], [np.repeat(weight, held)]
    for s in np.flatnonzero(~listed):
        places.append(np.flatnonzero(np.unpackbits(data[at[s]: at[s + 1]])))
        rows.append(np.full(len(places[-1]), row[s]))
        weights.append(np.full(len(places[-1]), weight[s]))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(weights)


def _empty(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


class _Bucket:
    """The documents of a bucket, as numbers of segments."""

    def __init__(self, segments: _Segments):
        self.s, self.ids, self.hashes, self.docs, self.chars = segments, [], [], [], 0

    def add(self, doc_ids: list, documents: list[str | None]) -> None:
        s = self.s
        cut = [_SEGMENT.findall(" " + t) if t else [] for t in documents]
        number = s.number
        new = {x for segs in cut for x in segs if x not in number}
        if new:
            s.learn(list(new))
        for doc_id, segs in zip(doc_ids, cut, strict=True):
            ids = list(map(number.__getitem__, segs))
            groups = list(map(s.groups.__getitem__, ids))
            good = bool(ids) and "" not in groups
            self.docs.append(doc_id)
            self.hashes.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if good else "")
            self.ids.append(np.array(ids if good else [], np.int64))
        self.chars += sum(len(t) for t in documents if t)

    def close(self, bucket: int):
        """The bucket's rows: its documents, then its postings."""
        sizes = np.array(self.s.sizes, np.int64).reshape(-1, 4)
        length = np.array([len(x) for x in self.ids])
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(self.docs)), length)
        totals = [np.bincount(doc, sizes[ids, c], minlength=len(self.docs)).astype(np.int64) for c in range(4)]
        n, where = len(self.docs), np.full(len(self.docs), bucket)
        yield pa.RecordBatch.from_arrays(
            [pa.array(where), pa.array(np.arange(n, dtype=np.int32)), pa.array(self.docs, pa.int64()), *map(pa.array, totals), pa.array(self.hashes, pa.string()),
             _empty(n, pa.int64()), _empty(n, pa.int64()), _empty(n, pa.list_(pa.binary()))], _NAMES)
        # distinct (document, segment), then their links, then distinct (pair, document) with the number of links
        key, times = np.unique(doc * max(1, len(sizes)) + ids, return_counts=True)
        doc, seg = key // max(1, len(sizes)), key % max(1, len(sizes))
        links = np.concatenate(self.s.links) if self.s.links else np.zeros(0, np.int64)
        from_ = np.cumsum(sizes[:, 3]) - sizes[:, 3]
        many = sizes[seg, 3]
        at = np.repeat(from_[seg] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pairs, local = np.unique(links[at], return_inverse=True)
        key = local * len(self.docs) + np.repeat(doc, many)
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.repeat(times, many)[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, times = key[first], np.add.reduceat(times, first) if len(first) else times
        pair, n_docs, planes = pack_planes(key // max(1, n), key % max(1, n), times, n)
        for lo in range(0, len(pair), 20_000):
            m = min(20_000, len(pair) - lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, bucket)), _empty(m, pa.int32()), *[_empty(m, pa.int64())] * 5, _empty(m, pa.string()),
                 pa.array(pairs[pair[lo: lo + m]]), pa.array(n_docs[lo: lo + m]), planes.slice(lo, m)], _NAMES)


_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _index(batches, path_a: str, path_b: str):
    segments = _segments(path_a, path_b)
    bucket_id, bucket = TaskContext.get().partitionId() << 32, _Bucket(segments)
    for batch in batches:
        length = np.asarray(pc.utf8_length(batch.column(1).fill_null("")))
        at = 0
        while at < batch.num_rows:
            to = at + max(1, int(np.searchsorted(np.cumsum(length[at: at + 4096]), STEP_CHARS, "right")))
            part = batch.slice(at, to - at)
            bucket.add(part.column(0).to_pylist(), part.column(1).to_pylist())
            at += part.num_rows
            if bucket.chars >= BUCKET_CHARS or len(bucket.docs) >= BUCKET_DOCS - 4096 or segments.chars > REMEMBER_CHARS:
                yield from bucket.close(bucket_id)
                if len(segments.groups) > REMEMBER or segments.chars > REMEMBER_CHARS:
                    segments.forget()
                bucket_id, bucket = bucket_id + 1, _Bucket(segments)
    if bucket.docs:
        yield from bucket.close(bucket_id)


def _scored(docs: pa.Table, postings: pa.Table) -> pa.Table:
    """A bucket's documents with the sums that its postings return."""
    docs, postings = docs.combine_chunks(), postings.combine_chunks()
    pos = np.asarray(docs.column("pos"), np.int64)
    n_best, count_sum = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    if len(postings):
        planes = postings.column("planes")
        planes = planes.chunk(0) if isinstance(planes, pa.ChunkedArray) else planes
        row, place, weight = unpack_planes(planes)
        np.add.at(count_sum, place, weight * np.asarray(postings.column("count"), np.int64)[row])
        np.add.at(n_best, place, weight * np.asarray(postings.column("best"), np.int64)[row])
    return pa.table({"doc_id": docs.column("doc_id"), **{c: docs.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")},
                     "n_best": n_best[pos], "count_sum": count_sum[pos], "groups_sha256": docs.column("groups_sha256")})


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold a pair linked, and whether no other pair of its A id has more."""
    counts = index.filter(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n_docs").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # at most one row for each id of B
    return counts.withColumn("best", (F.col("count") == F.max("count").over(of_a)).cast("long"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Token, group and link numbers of every document, and how common its links are in the corpus."""
    index = materialise(texts(docs).mapInArrow(lambda b: _index(b, path_a, path_b), INDEX), "alignment-index")
    counts = materialise(pair_counts(index), "pair-counts")
    # the pairs grow with the corpus: the same shuffled join at every size
    postings = index.filter(F.col("pair").isNotNull()).select("bucket", "pair", "planes").join(counts.hint("merge"), "pair").select(F.col("bucket").alias("of"), "planes", "count", "best")
    documents = index.filter(F.col("pos").isNotNull()).select("bucket", "pos", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return documents.groupBy("bucket").cogroup(postings.groupBy("of")).applyInArrow(_scored, RESULT)
