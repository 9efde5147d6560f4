"""Cross-tokenizer alignment against whole-text encoding and a plain count."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from retentia.llm import align
from retentia.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
_TOKENIZERS: dict = {}


def tokens(text):
    """Ids and byte ends in both vocabularies, from the whole text at once; None where the bytes differ."""
    if not _TOKENIZERS:
        a = Tokenizer.from_file(A)
        a.encode_special_tokens = True
        _TOKENIZERS.update(a=a, b=sentencepiece.SentencePieceProcessor(model_file=B))
    a, b = _TOKENIZERS["a"], _TOKENIZERS["b"]
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    byte = align._byte_level()
    part_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    part_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(part_a) == b"".join(part_b) == (" " + text).encode():
        return None
    return ids_a, np.cumsum([len(x) for x in part_a]).tolist(), ids_b, np.cumsum([len(x) for x in part_b]).tolist()


def brute(rows):
    """The contract, document by document."""
    found, docs_of = [], defaultdict(set)
    for n, (_, text) in enumerate(rows):
        t = tokens(text)
        links, groups = [], []
        if t:
            ids_a, end_a, ids_b, end_b = t
            for i, x in enumerate(ids_a):
                for j, y in enumerate(ids_b):
                    if max(end_a[i - 1] if i else 0, end_b[j - 1] if j else 0) < min(end_a[i], end_b[j]):
                        links.append((x, y))
            last = 0
            for cut in sorted(set(end_a) & set(end_b)):
                groups.append(",".join(str(x) for x, e in zip(ids_a, end_a) if last < e <= cut) + "|" + ",".join(str(y) for y, e in zip(ids_b, end_b) if last < e <= cut))
                last = cut
        for p in set(links):
            docs_of[p].add(n)
        found.append((links, groups, t))
    highest = Counter()
    for (x, _), docs in docs_of.items():
        highest[x] = max(highest[x], len(docs))
    return sorted((-1 if doc_id is None else doc_id, len(t[0]) if t else 0, len(t[2]) if t else 0, len(groups), len(links),
                   sum(len(docs_of[p]) == highest[p[0]] for p in links), sum(len(docs_of[p]) for p in links),
                   hashlib.sha256(";".join(groups).encode()).hexdigest() if t else "") for (doc_id, _), (links, groups, t) in zip(rows, found))


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_align_matches_brute_force(make_docs, small_texts):
    rows = [(i, t) for i, t in sorted(small_texts.items()) if len(t) < 1500][:60]
    odd = ["", None, " ", "  ", "a ", " a", "a  b   c", "tab\tand \n lines \n\n", "<|endoftext|> <s> <unk> <0x41>", "▁x y", "café 漢字　x \U0001f600",
           "don't we'll 'tis", "x  y", "nul\x00 z", "word " * 300, "word", "word", "​ ​", "é ́ a"]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [(1000, "again"), (None, "no id")]
    assert got(align.align(make_docs(rows), A, B)) == brute(rows)


def test_segments_encode_as_whole_texts_do():
    r = random.Random(5)
    s = align._Segments(A, B)
    alphabet = ["a", "the", "Zz", " ", " ", "  ", "\n", "\t", "'s", "1", "23", ".", "--", "é", "é", " ", "　", "▁", "漢", "\U0001f468‍\U0001f469", "\x00", "<s>", "<0x0A>", " ", "\x1c", "ﬁ"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 14)))
        segs = align._SEGMENT.findall(" " + text)
        assert "".join(segs) == " " + text
        s.learn([x for x in dict.fromkeys(segs) if x not in s.number])
        ids = [s.number[x] for x in segs]
        t = tokens(text)
        whole = all(s.sizes[i][0] >= 0 for i in ids)
        assert whole == (t is not None), repr(text)
        if t:
            a = [int(x) for i in ids for g in s.groups[i].split(";") for x in g.split("|")[0].split(",")]
            b = [int(x) for i in ids for g in s.groups[i].split(";") for x in g.split("|")[1].split(",")]
            assert (a, b) == (t[0], t[2]), repr(text)


def test_planes_round_trip():
    r = np.random.default_rng(3)
    n = 500
    pair, pos = np.divmod(np.unique(np.concatenate([r.integers(0, 20 * n, 900), np.arange(n)])), n)
    times = r.integers(1, 40, len(pair))
    pairs, docs, planes = align.pack_planes(pair, pos, times, n)
    row, place, weight = align.unpack_planes(planes)
    total = Counter()
    for i, p, w in zip(pairs[row].tolist(), place.tolist(), weight.tolist()):
        total[i, p] += w
    assert total == {(i, p): t for i, p, t in zip(pair.tolist(), pos.tolist(), times.tolist())}
    assert docs.tolist() == [int((pair == i).sum()) for i in pairs]
    sliced = align.unpack_planes(planes.slice(3, 5))
    keep = (row >= 3) & (row < 8)
    assert sorted(zip(*(x.tolist() for x in sliced))) == sorted(zip((row[keep] - 3).tolist(), place[keep].tolist(), weight[keep].tolist()))
    assert len(align.unpack_planes(align.pack_planes(pair[:0], pos[:0], times[:0], 3)[2])[0]) == 0


def test_small_buckets_give_the_same(make_docs, monkeypatch, small_texts):
    rows = [(i, t[:400]) for i, t in sorted(small_texts.items())][:40]
    import pyarrow as pa
    monkeypatch.setattr(align, "BUCKET_CHARS", 2000)
    monkeypatch.setattr(align, "STEP_CHARS", 500)
    monkeypatch.setattr(align, "REMEMBER", 100)
    monkeypatch.setattr(align.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    out = pa.Table.from_batches(list(align._index([batch], A, B)))
    index = out.to_pylist()
    assert len({r["bucket"] for r in index}) > 3
    counts = Counter()
    for r in index:
        if r["pair"] is not None:
            counts[r["pair"]] += r["n_docs"]
    docs = defaultdict(set)
    for n, (_, t) in enumerate(rows):
        ids_a, end_a, ids_b, end_b = tokens(t)
        for i, x in enumerate(ids_a):
            for j, y in enumerate(ids_b):
                if max(end_a[i - 1] if i else 0, end_b[j - 1] if j else 0) < min(end_a[i], end_b[j]):
                    docs[x << 32 | y].add(n)
    assert counts == {p: len(d) for p, d in docs.items()}


def test_empty_table(make_docs):
    assert align.align(make_docs([]), A, B).collect() == []
