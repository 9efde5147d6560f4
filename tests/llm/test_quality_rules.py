import random
import re
from collections import Counter

from pyspark.sql import functions as F

from retentia.llm.quality_rules import base_failed, judge, keep_good, learn, statistics


def brute(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_base_statistics_of_edge_cases(make_docs):
    rows = {1: None, 2: "", 3: " \t\n\x0b\x0c\r ", 4: "a", 5: "a a a a", 6: "a b c a b c", 7: "x\ny\nx\n\n\n y\ny", 8: "é ü # <|> 𝔘𝔘 a&b",
            9: "a b c d " * 3000, 10: "\x1c a \x85b c", 11: " ".join(str(i) for i in range(4000)), 12: "q q q"}
    got = {r.doc_id: counts(r) for r in statistics(make_docs(rows.items())).collect()}
    assert got == {i: brute(t) for i, t in rows.items()}


def test_base_statistics_of_whole_table(small, small_texts):
    got = {r.doc_id: counts(r) for r in statistics(small("documents")).collect()}
    assert got == {i: brute(t) for i, t in small_texts.items()}


def labelled(spark, seed, n=4000):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.random(), r.random(), r.random()
        rows.append((i, a, b, c, (a >= 0.8 and b < 0.5) or c >= 0.95))
    return spark.createDataFrame(rows, "doc_id long, a double, b double, c double, reject boolean")


def test_rules_recover_threshold_conjunctions(spark):
    rules = learn(labelled(spark, 1), ("a", "b", "c"))
    assert 2 <= len(rules.rules) <= 6
    held = labelled(spark, 2).withColumn("said", rules.reason().isNotNull())
    wrong = held.filter(F.col("said") != F.col("reject")).count()
    assert wrong <= 0.03 * 4000
    for rule in rules.rules:
        assert rule.covered[0] >= 0.9 * sum(rule.covered)


def test_no_rule_without_rejected_labels(spark):
    assert learn(labelled(spark, 1).withColumn("reject", F.lit(False)), ("a", "b", "c")).rules == []
    assert learn(labelled(spark, 1).limit(0), ("a", "b", "c")).rules == []


def test_few_rejects_on_a_zero_inflated_statistic(spark):
    """1 % of the rows are rejects, all beyond an exact cut of a statistic that is mostly 0."""
    r = random.Random(7)
    rows = [(i, 0.0 if r.random() < 0.9 else r.uniform(0, 0.09), r.random(), False) for i in range(3200)]
    rows += [(5000 + i, 0.098 + r.uniform(0, 0.2), r.random(), True) for i in range(32)]
    rules = learn(spark.createDataFrame(rows, "doc_id long, s double, b double, reject boolean"), ("s", "b"))
    said = {x.doc_id for x in spark.createDataFrame(rows, "doc_id long, s double, b double, reject boolean").filter(rules.reason().isNotNull()).collect()}
    kept = said ^ {i for i, *_ in rows if i >= 5000}
    assert len(kept) <= 1  # the smallest reject may be in the pruning part


def test_thresholds_are_refined_between_quantiles(spark):
    """Rejects have 3,000 values from 0.5 on and 3,000 others end just below: the cut is exact, not a quantile."""
    rows = [(i, i / 6000, i >= 3000) for i in range(6000)] + [(9000 + i, 2 + i / 6000, False) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, a double, reject boolean")
    rules = learn(df, ("a",))
    wrong = {x.doc_id for x in df.filter(rules.reason().isNotNull() != F.col("reject")).collect()}
    assert len(wrong) <= 4  # values beside the cut that are in the pruning part


def test_judge_and_filter(spark, make_docs):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    good = [(i, " ".join(word() for _ in range(80))) for i in range(120)]
    bad = [(i, " ".join(word() + "###" for _ in range(80))) for i in range(200, 280)]
    docs = make_docs(good + bad + [(500, None), (501, "short"), (None, good[0][1]), (0, good[0][1])])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:100]] + [(i, 0, 0) for i, _ in bad[:60]] + [(None, 0, 0), (9999, 0, 0), (1, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = judge(docs, labels).collect()
    assert len(got) == docs.count()
    assert {x.doc_id for x in got if x.kept} == {i for i, _ in good} | {None}
    assert {x.doc_id for x in got if x.base_failed} == {500, 501}
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 122
    assert judge(make_docs([]), labels).count() == 0
    none = judge(docs, labels.limit(0))
    assert none.filter("kept").count() == none.filter(~base_failed()).count()


def test_plan_has_no_python(small):
    plan = judge(small("documents"), small("labels"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
