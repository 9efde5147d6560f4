"""Source divergence against a plain count, with copies, nulls and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from retentia.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text)]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in sources}
        whole = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 5) // (sum(total.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            over = [(whole[t] - share[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and share[s][t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(items)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def docs_of(spark, rows):
    return spark.createDataFrame([(t, la, s, 1, "x", 2, "y") for t, la, s in rows], "text string, lang string, source string, n long, term string, copies long, h1 string")


def test_divergence_matches_brute_force(spark, monkeypatch):
    r = random.Random(2)
    words = ["the", "The", "café", "Été", "漢字", "x1y", "don't", "a_b", "zz@zz", "\U0001f600", "é", *[f"w{'abcdefghij'[i]}" for i in range(10)]]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None, ""]), r.choice(["s0", "s0", "s1", "s2", None, "é"])) for _ in range(200)]
    rows += [("the same text of many", "en", r.choice(["s0", "s1", "s3"])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "xx", "alone"), ("123 456", "yy", "a"), ("rare words only", "yy", "b"), ("long " * 20000, "en", "s2")]
    assert got(divergence.audit(docs_of(spark, rows), 5, 7)) == brute(rows, 5, 7)
    for name, value in (("SOURCES", 2), ("TERMS", 3)):  # many blocks and buckets
        monkeypatch.setattr(divergence, name, value)
    assert got(divergence.audit(docs_of(spark, rows), 30, 50)) == brute(rows, 30, 50)


def test_equal_texts_are_one_row(spark):
    rows = [("same", "en", "a")] * 40 + [("same", "en", "b")] * 2 + [("same", "de", "a"), (None, "en", "a"), ("", "en", "b")]
    found = {(r.lang, r.text): sorted(tuple(x) for x in r.sources) for r in divergence.collapsed(docs_of(spark, rows)).collect()}
    assert found == {("en", "same"): [("a", 40), ("b", 2)], ("de", "same"): [("a", 1)], ("en", ""): [("a", 1), ("b", 1)]}


def test_task_combines_in_parts(monkeypatch):
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": f"a b w{'xyz'[i % 3]}", "sources": [{"source": s, "copies": 2} for s in "pq"]} for i in range(50)])
    monkeypatch.setattr(divergence, "COMBINE_BYTES", 20)
    whole = pa.Table.from_batches(divergence.term_counts(iter([batch, batch]))).to_pylist()
    assert sorted((r["source"], r["term"], r["n"], r["docs"]) for r in whole)[:3] == [("p", "a", 200, 200), ("p", "b", 200, 200), ("p", "wx", 68, 68)]
    monkeypatch.setattr(divergence, "COMBINE_ROWS", 12)
    total = Counter()
    for r in pa.Table.from_batches(divergence.term_counts(iter([batch, batch]))).to_pylist():
        total[r["source"], r["term"]] += r["n"]
    assert total == {(r["source"], r["term"]): r["n"] for r in whole}


def test_empty_table(spark):
    assert got(divergence.audit(docs_of(spark, []))) == []
