"""Quality rules as a learned decision list (sequential covering).

Every document gets a row of text statistics, all from DataFrame functions.
Labelled documents with equal values are pre-aggregated into weighted cells,
and values are cut into bins at the quantiles of the reject class, however
small it is. Sequential covering then learns rules for the reject class: a rule
grows by the threshold condition with the best information gain on the growing
part of the cells, its threshold refined among the rejected values between the
neighbouring cuts (the whole search in steps of BINS quantiles), is pruned to
the prefix that does best on the pruning part, and the cells it covers are
taken out; it stops when a rule is no longer precise. Every search step is one
aggregation whose result has a row per feature and bin, or one of quantiles. The list is emitted as
one ordered conditional expression, so scoring is a plain projection.

Defined results: null and empty texts have zero statistics (and fail the word
minimum of ``op2``'s base); labels that are null or belong to no document are
not used; if an id carries several labels or texts, each pair counts; without
rejected labels the list is empty and keeps everything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import carried, discard, let, materialise, texts, word_array

BINS = 64
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
            "shout_share", "digit_share", "distinct_share", "words_per_line")


@dataclass
class Rule:
    """Reject if every condition (feature, at_least, threshold) holds."""

    conditions: list[tuple[str, bool, float]]
    covered: tuple[int, int] = (0, 0)  # rejected and other labels that the rule decided while learning


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def reason(self) -> Column:
        """Text of the first rule that fits, null if none does."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            fits = F.lit(True)
            for name, at_least, cut in rule.conditions:
                fits = fits & (F.col(name) >= cut if at_least else F.col(name) < cut)
            text = " and ".join(f"{n} {'>=' if ge else '<'} {c:.6g}" for n, ge, c in rule.conditions)
            out = F.when(fits, F.lit(text)).otherwise(out)
        return out


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more.

    A window is found twice if its hash has an equal neighbour in the sorted
    array of (hash, place); most texts repeat none and skip the sort. Linear
    in the text but for the sort.
    """
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def places(s: Column) -> Column:
        near = lambda j, x: F.get(s, j)["g"].eqNullSafe(x["g"])
        marked = F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (near(j - 1, x) | near(j + 1, x)).alias("twice")))
        return F.sort_array(F.transform(F.filter(marked, lambda x: x["twice"]), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i + 3 - F.greatest(a["end"], i)).cast("long")).alias("n"), (i + 3).alias("end"))
        return F.aggregate(p, start, step, lambda a: a["n"])

    found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), let(
        F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))), lambda s: let(places(s), covered))))
    return F.coalesce(F.when(F.size(words) >= 3, found), F.lit(0).cast("long"))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each document with its text statistics.

    They are the output of a generator, which filters on them do not pass: an
    expression this long must run once a row.
    """
    count = lambda text, others: F.length(F.regexp_replace(text, others, "")).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = let(text, lambda t: let(word_array(t), lambda w: let(F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \t-\r]")), lambda lines: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count(t, "[^#*$%&|<>]+").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        count(t, r"\P{Lu}+").alias("n_upper"),
        count(t, "[^!?]+").alias("n_shouts"),
        count(t, r"\P{Nd}+").alias("n_digits"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct")))))
    counted = docs.select(*keep, F.inline(F.array(base)))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1).cast("long"))
    return counted.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        share("word_chars", "n_words").alias("word_length"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"), share("n_shouts", "n_words").alias("shout_share"),
        share("n_digits", "word_chars").alias("digit_share"), share("n_distinct", "n_words").alias("distinct_share"),
        share("n_words", "n_lines").alias("words_per_line"))


def base_failed() -> Column:
    """The fixed base rule over ``statistics``: too short, or more than half repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def learn(labelled: DataFrame, features: tuple[str, ...] = FEATURES, min_precision: float = 0.9, min_rejected: int = 5,
          max_conditions: int = 8, max_rules: int = 32) -> DecisionList:
    """A decision list for ``reject`` (boolean) from rows of statistics.

    ``max_conditions`` and ``max_rules`` bound the model, not the data.
    """
    rows = labelled.select(*[F.col(f).cast("double").alias(f) for f in features], F.col("reject").cast("int").alias("reject"),
                           (F.pmod(F.xxhash64(F.col("doc_id")), F.lit(3)) > 0).alias("grow")).dropna()
    cells = materialise(rows.groupBy("grow", *features).agg(F.sum("reject").alias("p"), F.sum(1 - F.col("reject")).alias("n")), "cells")

    def quantiles(seen, names):
        """Cuts at the quantiles of the rejected rows: where a value begins and, for conditions from above, where it has ended."""
        found = seen.filter("p > 0").agg(*[F.percentile_approx(f, [(i + 1) / BINS for i in range(BINS)], 10_000).alias(f) for f in names]).first()
        return {f: sorted({c for v in found[f] or [] for c in (v, math.nextafter(v, math.inf))}) for f in names}

    # the best cut of a statistic is always beside a rejected value: any other can be moved there and loses only rows that stay
    cuts = quantiles(cells, features)

    # bin b of a value: the number of cuts at or below it, so value >= cuts[b - 1] and value < cuts[b]
    def bin_of(f, cuts):
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col(f)))

    plain, cells = cells, materialise(cells.select("*", *[bin_of(f, cuts[f]).alias(f"{f}_bin") for f in features]), "binned-cells")
    discard(plain)

    def where(conditions):
        out = F.lit(True)
        for f, at_least, c in conditions:
            out = out & (F.col(f) >= c if at_least else F.col(f) < c)
        return out

    def best_cut(counts, f, cuts, p0, n0, best):
        """The better of ``best`` and the cuts of a statistic, by p and n of its bins."""
        p = n = 0
        for b in sorted(counts):  # below b, and from b on
            for at_least, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                if b and q + m < p0 + n0 and (g := _gain(q, m, p0, n0)) > best[0]:
                    best = (g, (f, at_least, cuts[b - 1]))
            p, n = p + counts[b][0], n + counts[b][1]
        return best

    def refined(seen, counts, best, p0, n0):
        """The best cut between the bins beside the one chosen, with ever finer quantiles, until no rejected value lies between."""
        f, near = best[1][0], cuts[best[1][0]]
        while True:
            b = near.index(best[1][2]) + 1
            last = max(x for x in counts if x < b)  # the bin with rows before the cut
            low, high = near[last - 1] if last else -math.inf, near[b] if b < len(near) else math.inf
            inside = seen.filter((F.col(f) >= low) & (F.col(f) < high) & (F.col("p") > 0)).select(f, "p").dropDuplicates([f])
            more = set(quantiles(inside, [f])[f]) - set(near)
            if not more:
                return best
            near = sorted(more | {c for c in near if low <= c <= high})
            counts = {b: (p, n) for b, p, n in seen.groupBy(bin_of(f, near).alias("b")).agg(F.sum("p"), F.sum("n")).collect()}
            best = best_cut(counts, f, near, p0, n0, best)

    def candidates(seen):
        """p and n of the growing cells by feature and bin."""
        got: dict = {f: {} for f in features}
        for f, b, p, n in (seen.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"{f}_bin").alias("b")) for f in features])).alias("x"), "p", "n")
                           .groupBy("x").agg(F.sum("p"), F.sum("n")).select("x.f", "x.b", "sum(p)", "sum(n)").collect()):
            got[f][b] = (p, n)
        return got

    taken, rules = [], []

    def left(grow):
        out = cells.filter(F.col("grow") == grow)
        for c in taken:
            out = out.filter(~where(c))
        return out

    while len(rules) < max_rules:
        conditions, p0, n0 = [], 0, 0
        while len(conditions) < max_conditions:
            seen = left(True).filter(where(conditions))
            counts = candidates(seen)
            one = counts[features[0]].values()
            p0, n0 = sum(x[0] for x in one), sum(x[1] for x in one)
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for f in features:
                best = best_cut(counts[f], f, cuts[f], p0, n0, best)
            if not best[1]:
                break
            best = refined(seen, counts[best[1][0]], best, p0, n0)
            conditions.append(best[1])
        if not conditions:
            break
        prefixes = [conditions[: i + 1] for i in range(len(conditions))]
        sums = left(False).agg(*[F.coalesce(F.sum(F.when(where(c), F.col(v))), F.lit(0)) for c in prefixes for v in ("p", "n")]).first()
        scores = [(sums[2 * i], sums[2 * i + 1]) for i in range(len(prefixes))]
        i = max(range(len(scores)), key=lambda i: ((scores[i][0] - scores[i][1]) / max(1, sum(scores[i])), scores[i][0], -i))
        kept = prefixes[i]
        p, n = cells.filter(where(kept)).filter(F.lit(True) if not taken else ~F.greatest(*[where(c) for c in taken], F.lit(False))).agg(
            F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if p < min_rejected or p < min_precision * (p + n):
            break
        taken.append(kept)
        rules.append(Rule(kept, (p, n)))
    discard(cells)
    return DecisionList(rules)


def decision_list(stats: DataFrame, labels: DataFrame) -> DecisionList:
    """Rules learned from the statistics of every labelled document that passes the base rule.

    Only the narrow statistics are joined to the labels; texts are not shuffled.
    """
    marked = labels.filter("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("reject"))
    seen = materialise(stats.filter(~base_failed()).join(marked, "doc_id"), "labelled")
    rules = learn(seen)
    discard(seen)
    return rules


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every document with ``base_failed``, ``kept`` and the ``reason`` of a rejection."""
    stats = materialise(statistics(texts(docs)), "statistics")
    rules = decision_list(stats, labels)
    return (stats.withColumn("base_failed", base_failed())
            .withColumn("reason", F.when(F.col("base_failed"), F.lit("base")).otherwise(rules.reason()))
            .withColumn("kept", F.col("reason").isNull()))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    stats = materialise(statistics(texts(docs)), "statistics")
    rules = decision_list(stats, labels)
    discard(stats)
    # statistics are worked out again beside the rows: cheaper than shuffling whole texts to join them
    return statistics(carried(docs), ("_row",)).filter(~base_failed() & rules.reason().isNull()).select("_row.*")
