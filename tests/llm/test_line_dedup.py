import random

from pyspark.sql import functions as F

import pytest

from retentia.llm import line_dedup
from retentia.llm.line_dedup import drop_repeated_lines, edit_distance, removed_lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(r, s, n, letters="abcé𝔘 "):
    s = list(s)
    for _ in range(n):
        k, at = r.randrange(3), r.randrange(len(s) + 1)
        if k == 0:
            s.insert(at, r.choice(letters))
        elif s:
            at = min(at, len(s) - 1)
            s[at: at + 1] = [] if k == 1 else [r.choice(letters)]
    return "".join(s)


def test_banded_distance_against_the_full_table(spark):
    r = random.Random(1)
    rows = [("", ""), ("", "a"), ("ab", ""), ("abc", ""), ("a", "b"), ("ab", "ba"), ("abcdef", "badcfe"), ("a" * 30, "a" * 31)]
    for i in range(400):
        s = "".join(r.choice("abcé𝔘 ") for _ in range(r.randrange(0, 60)))
        rows.append((s, mutate(r, s, r.randrange(0, 6))))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        for x in df.withColumn("d", edit_distance(F.col("a"), F.col("b"), k)).collect():
            true = levenshtein(x.a, x.b)
            assert (x.d == true) if true <= k else x.d > k, (k, x, true)


def brute(rows, edits=2, least=30):
    first, places = {}, []
    key = lambda d: (d is not None, d or 0)
    for d, t in sorted(set(rows), key=lambda x: key(x[0])):
        for n, line in enumerate((t or "").split("\n")):
            if len(line) >= least:
                places.append((d, n, line))
                first.setdefault(line, (d, n))
    order = {line: (key(p[0]), p[1]) for line, p in first.items()}
    out = set()
    for d, n, line in places:
        if first[line] != (d, n):
            out.add((d, n, 0, *first[line]))
            continue
        near = [(order[o], levenshtein(line, o), first[o]) for o in first if order[o] < order[line] and abs(len(o) - len(line)) <= edits]
        near = sorted((p, e, f) for p, e, f in near if e <= edits)
        if near:
            out.add((d, n, near[0][1], *near[0][2]))
    return out


def corpus():
    r = random.Random(5)
    line = lambda: "".join(r.choice("abcdefgh é") for _ in range(r.randrange(28, 70)))
    base = [line() for _ in range(25)]
    rows = []
    for d in range(60):
        lines = [mutate(r, r.choice(base), r.choice([0, 0, 1, 2, 3, 5])) if r.random() < 0.6 else line() for _ in range(r.randrange(0, 8))]
        rows.append((d, "\n".join(lines)))
    return rows + [(900, None), (901, ""), (902, "\n\n"), (903, base[0] + "\n" + base[0]), (904, "z" * 5000), (905, "z" * 5001), (None, base[1])]


def test_removed_lines_against_brute_force(make_docs):
    rows = corpus()
    got = removed_lines(make_docs(rows)).drop("_key").collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("edits", [1, 2])
def test_finer_keys_lose_no_pair(make_docs, monkeypatch, edits):
    monkeypatch.setattr(line_dedup, "HOT", 0)  # every line meets the others on finer keys only
    rows = corpus()
    assert set(map(tuple, removed_lines(make_docs(rows), edits).drop("_key").collect())) == brute(rows, edits)


def test_lines_keyed_at_every_occurrence_count_once(make_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "COMMON", 1)  # no line is common: each is keyed wherever it occurs
    monkeypatch.setattr(line_dedup, "HOT", 2)  # some keys are crowded, some are not
    rows = corpus()
    assert set(map(tuple, removed_lines(make_docs(rows)).drop("_key").collect())) == brute(rows)


@pytest.mark.parametrize("edits", [1, 2])
def test_halved_pieces_lose_no_pair(make_docs, monkeypatch, edits):
    """Crowded finer keys are halved to single characters, where a line meets the earliest one in reach."""
    monkeypatch.setattr(line_dedup, "CROWD", 1)
    monkeypatch.setattr(line_dedup, "HOT", 1)
    r = random.Random(edits)
    base, rows = "".join(r.choice("abcdefgh") for _ in range(36)), []
    for d in range(90):
        s, spots = list(base), [0, 4, 5, 35] if d % 2 else range(36)
        for _ in range(r.choice([0, 1, 2, 3])):
            at, k = min(r.choice(spots), len(s) - 1), r.randrange(3)
            s[at: at + (k > 0)] = [] if k == 1 else [r.choice("xy")]
        rows.append((d * 7 % 90, "".join(s)))
    assert set(map(tuple, removed_lines(make_docs(rows), edits).drop("_key").collect())) == brute(rows, edits)


def test_near_copies_are_not_met_pair_by_pair(make_docs, monkeypatch):
    """225 lines that differ in the same two characters used to be verified as 25,200 pairs."""
    met, write = {}, line_dedup.materialise

    def counted(df, name):
        out = write(df, name)
        if name == "line-pairs":
            met[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    values = "abcdefghijklmno"
    rows = [(i * 15 + j, f"number {x}{y} of a long list of equal lines") for i, x in enumerate(values) for j, y in enumerate(values)]
    got = {tuple(x) for x in removed_lines(make_docs(rows)).drop("_key").collect()}
    assert got == {(d, 0, (d >= 15) + (d % 15 > 0), 0, 0) for d in range(1, 225)}
    assert met["line-pairs"] <= 2 * line_dedup.HOT * 225


def test_keys_shuffle_no_text(make_docs, monkeypatch):
    """Lines used to be read from shuffled documents, and their keys joined in several passes."""
    plans, write = {}, line_dedup.materialise

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(line_dedup, "materialise", seen)
    line_dedup.near_lines(make_docs(corpus()[:20]))
    assert "Window" in plans["met-lines"] and "Join Inner" not in plans["met-lines"]


@pytest.mark.parametrize("slots", [1, 5])
def test_shared_slots_lose_no_text(make_docs, monkeypatch, slots):
    monkeypatch.setattr(line_dedup, "SLOTS", slots)
    rows = corpus()
    assert set(map(tuple, removed_lines(make_docs(rows)).drop("_key").collect())) == brute(rows)


def test_no_plan_repeats_the_documents_often(make_docs, monkeypatch):
    """The driver holds a plan with all that it repeats: the one plan of before named its tables 108 times."""
    scans, write = [], line_dedup.materialise

    def counted(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        scans.append(plan.size())
        return write(df, name)

    monkeypatch.setattr(line_dedup, "materialise", counted)
    line_dedup.near_lines(make_docs(corpus()[:20]))
    assert max(scans) <= 60, scans


def test_repeated_rows_join_once(make_docs):
    r = random.Random(9)
    a = "".join(r.choice("abcdefgh") for _ in range(60))
    docs = make_docs([(1, a)] * 200 + [(2, a + "x")] * 200)
    assert {tuple(x) for x in removed_lines(docs).drop("_key").collect()} == {(2, 0, 1, 1, 0)}


def test_repeated_rows_are_one_document(make_docs):
    rows = corpus()
    got = removed_lines(make_docs(rows + rows[3:9])).drop("_key").distinct().collect()
    assert set(map(tuple, got)) == brute(rows)


def test_documents_without_the_lines(make_docs):
    rows = corpus()
    docs = make_docs(rows)
    out = drop_repeated_lines(docs)
    assert out.columns == docs.columns
    gone = {}
    for d, n, *_ in brute(rows):
        gone.setdefault(d, set()).add(n)
    expected = []
    for d, t in rows:
        if d in gone:
            t = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])
            if not t.strip():
                continue
        expected.append((d, t))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(expected, key=key)
    assert drop_repeated_lines(make_docs([])).count() == 0


def test_plan_has_no_python(make_docs):
    plan = drop_repeated_lines(make_docs(corpus()[:5]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_short_lines_go_if_they_are_equal(make_docs):
    docs = make_docs([(1, "All rights reserved.\n\n  \nsome words"), (2, "All rights reserved.\n\n  \nAll rights reserved!"), (3, "x\nsome words\nx")])
    got = {tuple(r) for r in removed_lines(docs).drop("_key").collect()}
    assert got == {(2, 0, 0, 1, 0), (3, 1, 0, 1, 3), (3, 2, 0, 3, 0)}
    assert {r.doc_id: r.text for r in drop_repeated_lines(docs).collect()}[2] == "\n  \nAll rights reserved!"
