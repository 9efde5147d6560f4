import random

from hypothesis import given, settings
from hypothesis import strategies as st

from retentia.llm.decontaminate import contaminated, drop_contaminated, tile

WORDS = [f"w{i}" for i in range(400)]


def text(seed, n):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def greedy_tiles(doc, item, least):
    """Plain greedy string tiling: the longest free common run again and again."""
    df, itf, total = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while j + n < len(doc) and i + n < len(item) and df[j + n] and itf[i + n] and doc[j + n] == item[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        if best[0] < least:
            return total
        n, j, i = best
        df[j: j + n] = itf[i: i + n] = [False] * n
        total += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=18), st.lists(st.integers(0, 3), max_size=14), st.integers(1, 4))
def test_tiles_are_valid_and_reach_the_first_greedy_tile(doc, item, least):
    tiles = tile(doc, item, [True] * len(doc), least)
    used_doc, used_item = set(), set()
    for j, i, n in tiles:
        assert n >= least and doc[j: j + n] == item[i: i + n]
        assert not used_doc & set(range(j, j + n)) and not used_item & set(range(i, i + n))
        used_doc |= set(range(j, j + n))
        used_item |= set(range(i, i + n))
    brute = greedy_tiles(doc, item, least)
    assert (brute > 0) == bool(tiles)
    if brute:  # nothing of the least length is left uncovered
        free_d, free_i = [x not in used_doc for x in range(len(doc))], [x not in used_item for x in range(len(item))]
        d2 = [v if f else -1 - k for k, (v, f) in enumerate(zip(doc, free_d))]
        i2 = [v if f else -100 - k for k, (v, f) in enumerate(zip(item, free_i))]
        assert greedy_tiles(d2, i2, least) == 0


def test_planted_passages(spark, make_docs):
    item = text(1, 40)
    parts = [item[0:10], item[10:22], item[22:31], item[31:40]]
    loud = " ".join(item).upper().replace(" ", ", ")
    rows = [
        (1, " ".join(text(2, 300) + item + text(3, 200))),                                 # verbatim
        (2, " ".join(text(4, 50) + parts[2] + text(5, 9) + parts[0] + text(6, 7) + parts[3] + parts[1])),  # reordered
        (3, loud + ". " + " ".join(text(7, 60))),                                           # case and punctuation
        (4, " ".join(text(8, 100) + item[:12] + text(9, 100))),                             # 30 %: not a leak
        (5, " ".join(text(10, 400))), (6, None), (7, ""), (None, " ".join(item)), (1, " ".join(item)), (1, " ".join(item)),
    ]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "a b"), (13, " ".join(text(99, 30)))], "item_id long, text string")
    got = contaminated(make_docs(rows), bench).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in got) == [(False, 1, 10)] * 3 + [(False, 2, 10), (False, 3, 10), (True, 0, 10)]
    assert next(r.n_tiles for r in got if r.doc_id == 2) >= 4
    kept = drop_contaminated(make_docs(rows), bench)
    assert kept.columns == make_docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    # blocks of the query set change nothing
    again = contaminated(make_docs(rows), bench, block_words=10).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(make_docs([(1, "a b c d e")]), bench).count() == 0
    assert contaminated(make_docs([]), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_small_tables_against_brute_force(small, small_texts):
    import re
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: words(r.text) for r in small("benchmark").collect()}
    got = {(r.doc_id, r.item_id): r.matched_words for r in contaminated(small("documents"), small("benchmark")).collect()}
    seeds = {}
    for k, w in items.items():
        for p in range(len(w) - 3):
            seeds.setdefault(tuple(w[p: p + 4]), set()).add(k)
    expected = set()
    for d, t in small_texts.items():
        w = words(t)
        for k in {k for p in range(len(w) - 3) for k in seeds.get(tuple(w[p: p + 4]), ())}:
            at = [p for p in range(len(w) - 3) if k in seeds.get(tuple(w[p: p + 4]), ())]
            part = w[max(0, at[0] - 2): at[-1] + 6]
            if greedy_tiles(part, items[k], 4) >= 0.5 * len(items[k]):
                expected.add((d, k))
    assert set(got) == expected and expected


def test_short_items_match_whole(spark, make_docs):
    bench = spark.createDataFrame([(1, "Alpha, beta gamma"), (2, "gamma delta"), (3, "zeta"), (4, " .,"), (5, None), (6, "one two three four five six")], "item_id long, text string")
    docs = make_docs([(1, "x alpha BETA gamma y"), (2, "alpha beta x gamma delta"), (3, "zeta"), (4, "one two three"), (5, ""), (6, None), (7, "zeta one two three four")])
    got = sorted((r.doc_id, r.item_id, r.matched_words, r.item_words) for r in contaminated(docs, bench).collect())
    assert got == [(1, 1, 3, 3), (2, 2, 2, 2), (3, 3, 1, 1), (7, 3, 1, 1), (7, 6, 4, 6)]
