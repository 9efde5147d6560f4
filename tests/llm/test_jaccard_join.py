import random

import pytest

from retentia.llm import jaccard_join
from retentia.llm.jaccard_join import keep_one, least_matches
from retentia.llm.jaccard_join import jaccard_join as join


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], least[find(i)], links[i]) for i in range(len(rows))), key=str)


def rows():
    r = random.Random(3)
    word = lambda: f"w{r.randrange(500)}"
    out = []
    for g in range(12):
        base = [word() for _ in range(r.randrange(20, 200))]
        for _ in range(r.randrange(1, 14)):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = word()
            out.append((len(out), ("  " if r.random() < 0.2 else " ").join(w)))
    out += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one  two"), (905, "one two three"), (906, "one two three four five"),
            (None, out[0][1]), (0, out[0][1]), (907, "z " * 20000)]
    return out


@pytest.mark.parametrize("block", [256, 4])
def test_classes_and_links_against_brute_force(make_docs, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # 4: groups are worked in many pairs of blocks
    got = join(make_docs(rows())).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows())


def test_small_table(small, small_texts):
    got = join(small("documents")).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute(list(small_texts.items()))


def test_one_of_each_group_stays(make_docs):
    docs = make_docs(rows())
    out = keep_one(docs)
    assert out.columns == docs.columns
    classes = {}
    for d, c, _ in brute(rows()):
        classes.setdefault(c if d is not None or c is not None else "none", set()).add(d)
    assert sorted(r.doc_id for r in out.collect()) == sorted(c for c in classes if c != "none")


def test_pruning_is_safe():
    least = least_matches(0.8)
    assert least == sorted(least) and 0 < least[0] < 0.8 * jaccard_join.STEP
    r = random.Random(2)
    for _ in range(2000):  # a pair at the threshold survives every step
        m = 0
        for k, need in enumerate(least):
            m += sum(r.random() < 0.8 for _ in range(jaccard_join.STEP))
            assert m >= need, k


def test_empty_table(make_docs):
    assert join(make_docs([])).count() == 0
    assert sorted(map(tuple, join(make_docs([(1, None), (2, "")])).select("class_id", "n_links").collect())) == [(1, 0), (2, 0)]
