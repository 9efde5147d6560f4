import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from retentia.llm import packing
from retentia.llm.packing import fullest, pack, plan_bins

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 25), max_size=10), st.integers(0, 40))
def test_fullest_choice_is_the_best_subset_sum(lengths, capacity):
    counts = {n: lengths.count(n) for n in lengths}
    use = fullest(counts, capacity)
    assert all(k <= counts[n] for n, k in use.items())
    got = sum(n * k for n, k in use.items())
    assert got == max(s for k in range(len(lengths) + 1) for c in combinations(lengths, k) if (s := sum(c)) <= capacity)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_bins_hold_every_piece_once(counts):
    plan = plan_bins(counts, 64)
    used = {}
    for times, use in plan:
        assert sum(n * k for n, k in use) <= 64
        for n, k in use:
            used[n] = used.get(n, 0) + times * k
    assert used == counts
    bins = []  # first fit, longest first
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            i = next((i for i, b in enumerate(bins) if b + n <= 64), None)
            if i is None:
                bins.append(n)
            else:
                bins[i] += n
    assert sum(t for t, _ in plan) <= 4 / 3 * len(bins) + 1


def test_many_lengths_fill_nearly_every_bin():
    rng = np.random.default_rng(4)
    counts = dict(zip(*[x.tolist() for x in np.unique(np.minimum(2048, rng.lognormal(6.2, 0.9, 20000).astype(int) + 1), return_counts=True)], strict=True))
    total = sum(n * c for n, c in counts.items())
    assert sum(t for t, _ in plan_bins(counts, 2048)) <= -(-total // 2048) * 1.002 + 1


def check(rows, texts, capacity):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // capacity)))
        for r in got:
            part = ids[r.piece * capacity: (r.piece + 1) * capacity]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(part), zlib.crc32(part.tobytes()))
            if "ids" in r:
                assert r.ids == part.tolist()
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_round_trip_of_the_small_table(small, small_texts):
    rows = pack(small("documents"), PATH).collect()
    n = check(rows, small_texts, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_edge_cases(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 7)  # many numbering buckets
    texts = {1: None, 2: "", 3: "Hello, wörld  it's\n\tfine\x1cnow", 4: "word " * 500, 5: "<|endoftext|>a <|startoftext|>", 6: "ΑΣ ΣΑΣ İ é 1234 don't!!", 7: "x" * 3000}
    texts |= {i: "same text" for i in range(100, 160)}
    rows = pack(make_docs(texts.items()), PATH, capacity=64, with_ids=True).collect()
    check(rows, texts, 64)
    twice = pack(make_docs([(1, "a b"), (1, "a b"), (None, "c")]), PATH).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3
    assert pack(make_docs([]), PATH).count() == 0


def test_ids_equal_direct_encoding_of_any_text():
    from tokenizers import Tokenizer
    direct = Tokenizer.from_file(PATH)
    r = random.Random(9)
    letters = [*"aAbBjJhHtTwWyYzZ.,!'-1 ", "\t", "\n", "J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "\u0301", "\u0327", "\u0345", "\u036f", "\u0370", "\u20d7",
               "\u00e9", "\u00c9", "\u01f0", "\u212b", "\u1e9e", "\u0130", "\u00a0", "\u3000", "\u6f22", "\U0001f600", "\u200d", "the", "Word", "<|", "<|endoftext|>"]
    rows = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    for at in range(0, len(rows), 2000):
        part = rows[at: at + 2000]
        expected = [np.asarray(e.ids, "<u4").tobytes() for e in direct.encode_batch(part, add_special_tokens=False)]
        for text, got, ids in zip(part, packing.encode(part, PATH), expected):
            assert got == ids, repr(text)


def test_each_word_is_looked_up_once():
    class Counting(dict):
        looks = 0

        def get(self, *a):
            Counting.looks += 1
            return super().get(*a)

    path = PATH
    tokenizer, _ = packing._encoder(path)
    texts_ = ["The cat, the cat.. sat!", None, "", "A new (word) re-read; x1! é. 9. end"]
    packing._STATE["cache"] = Counting()
    try:
        got = [np.frombuffer(b, "<u4").tolist() for b in packing.encode(texts_, path)]
        assert Counting.looks == sum(len(packing._words(t.encode())) for t in texts_ if t)
    finally:
        packing._STATE["cache"] = {}
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts_]
