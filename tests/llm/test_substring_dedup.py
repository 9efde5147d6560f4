import hashlib
import random
from collections import Counter

import pytest

from retentia.llm import substring_dedup
from retentia.llm.substring_dedup import remove_repeats


def brute(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    n = Counter(tuple(w[s: s + 35]) for _, w in words for s in range(len(w) - 34))
    out = []
    for i, w in words:
        gone = bytearray(len(w))
        for s in range(len(w) - 34):
            if n[tuple(w[s: s + 35])] > 1:
                gone[s: s + 35] = b"\1" * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows():
    r = random.Random(7)
    word = lambda: r.choice(["a", "bb", "é", "the", "x1", "Q", "of,", "𝔘"])
    many = lambda n: [f"{word()}{r.randrange(40)}" for _ in range(n)]
    passage, long = many(60), many(400)
    out = []
    for i in range(80):
        p = passage if i % 2 else passage[: 20 + i // 2]
        out.append((i, " ".join(many(r.randrange(0, 90))) + " \n" + "\t".join(p) + "  " + " ".join(many(r.randrange(0, 60)))))
    out += [(200 + i, " ".join(long[: 40 + 30 * i])) for i in range(8)]
    out += [(300, None), (301, ""), (302, "the " * 900), (303, "the " * 34), (304, "the " * 35), (305, " ".join(["a", "b"] * 100)), (306, " ".join(many(34))),
            (307, "\x1c".join(passage)), (None, " ".join(passage)), (200, " ".join(long[:40])), (308, " ".join(many(50)) + "\x0b" + " ".join(long[5:39]))]
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_against_brute_force(make_docs, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)  # 1: every mixed group goes by whole windows
    got = remove_repeats(make_docs(rows())).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows())


def test_window_ranks_sort_whole_windows():
    import numpy as np
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2, 400)
    rank = substring_dedup.window_ranks(words)
    windows = [tuple(words[i: i + 35]) for i in range(len(words) - 34)]
    order = {w: k for k, w in enumerate(sorted(set(windows)))}
    assert rank.tolist() == [order[w] for w in windows]


def test_small_table(small, small_texts):
    got = remove_repeats(small("documents")).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute(small_texts.items())


def test_empty_table(make_docs):
    assert remove_repeats(make_docs([])).count() == 0
