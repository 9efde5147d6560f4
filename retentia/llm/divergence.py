"""How far the sources of a language differ in their words.

Equal texts of a language are collapsed first: one row a text with the number of its
copies in each source. Each text is then tokenised once and its counts are
weighted by these numbers, in numpy over slices of many texts, so that what
leaves a task is one row per (language, source, term) of a slice. Pairs of
sources are evaluated in blocks of sources over buckets of terms: a term that
neither source has always adds the same difference, so the value is that
difference times the vocabulary plus corrections for the terms that one of them has.

Equality of texts is equality of 128 bits of hash. All results are exact
integers: shares are whole billionths from decimal division, sums are longs.

Defined results: a null text, language or source is ''. A language without
kept terms has pairs of value 0 and no terms; a source alone in its language
has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.common import materialise, split_words, text_slices

# Bytes of text whose counts are combined before they leave Python.
COMBINE_BYTES = 2 << 20
# Rows of a task that are combined before they leave it; more distinct ones leave in parts.
COMBINE_ROWS = 1_500_000
# Sources of a block and terms of a bucket: bound the memory of one group.
SOURCES = 64
TERMS = 1024
# ASCII bytes that are no letters separate terms; other bytes belong to letters of more than one byte.
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32

COUNTS = "lang string, source string, term string, n long, docs long"


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, sources): each text of a language once, with (source, copies) for each source that has it."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.select("lang", "source", "text", F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"))
    key = ["h1", "h2", "lang"]
    copies = (rows.groupBy(*key, "source").agg(F.count(F.lit(1)).alias("copies"))
              .groupBy(*key).agg(F.collect_list(F.struct("source", "copies")).alias("sources")))
    return rows.groupBy(*key).agg(F.first("text").alias("text")).join(copies, key).select("lang", "text", "sources")


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys and each value's sum over them."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def term_counts(batches):
    """Arrow batches of collapsed texts -> their terms' counts and document numbers for each source, combined over the task."""
    held, size = [], 0

    def combined() -> pa.Table:
        table = pa.Table.from_batches(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return table.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

    for part in slice_counts(batches):
        held.append(part)
        size += part.num_rows
        if size > COMBINE_ROWS:
            table = combined()
            held, size = table.to_batches(), table.num_rows
            if size > COMBINE_ROWS // 2:
                yield from table.to_batches(max_chunksize=50_000)
                held, size = [], 0
    if held:
        yield from combined().to_batches(max_chunksize=50_000)


def slice_counts(batches):
    """The same for slices of a few megabytes, one after the other."""
    for rows, data, offsets in text_slices(batches, COMBINE_BYTES):
        folded = _FOLD[data]
        word, start, end, row = split_words(folded, offsets, ~_LETTER)
        if not len(word):
            continue
        _, example, term = np.unique(word, return_index=True, return_inverse=True)
        n_terms = len(example)
        key, count = _summed(row * n_terms + term, np.ones(len(row), np.int64))
        row, term = key // n_terms, key % n_terms
        sources = rows.column(rows.schema.get_field_index("sources"))
        at = np.asarray(sources.offsets) - sources.offsets[0].as_py()
        entries = sources.flatten()
        name, copies = entries.field("source").dictionary_encode(), np.asarray(entries.field("copies"))
        lang = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
        names = np.asarray(name.indices, np.int64) + len(name.dictionary) * np.repeat(np.asarray(lang.indices, np.int64), np.diff(at))
        many = np.diff(at)[row]  # a term of a text counts once in each source that has the text
        entry = np.repeat(at[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
        term, count, copies = np.repeat(term, many), np.repeat(count, many), copies[entry]
        key, n, docs = _summed(names[entry] * n_terms + term, count * copies, copies)
        group, term = key // n_terms, key % n_terms
        length = (end - start)[example]
        word_at = np.concatenate([[0], np.cumsum(length)])
        place = np.repeat(start[example] - word_at[:-1], length) + np.arange(word_at[-1])
        words = pa.StringArray.from_buffers(n_terms, pa.py_buffer(word_at.astype(np.int32).tobytes()), pa.py_buffer(folded[place].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(group // len(name.dictionary))).cast(pa.string()),
             name.dictionary.take(pa.array(group % len(name.dictionary))).cast(pa.string()),
             words.take(pa.array(term)), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def _share(count: str, total: str) -> F.Column:
    """1 + floor(1000000000 * (count + 5) / (total + 5 * terms)), exact; 0 for a language without terms."""
    return F.expr(f"CASE WHEN terms > 0 THEN 1 + (1000000000BD * CAST({count} + 5 AS DECIMAL(20, 0))) div CAST({total} + 5 * terms AS DECIMAL(20, 0)) ELSE 0L END")


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, n_lang, first): counts of the kept terms; ``first`` marks one row of a term."""
    # combined within the tasks and dealt out by term: the sums and the totals over sources need no further shuffle
    counts = (collapsed(docs).mapInArrow(term_counts, COUNTS).repartition("lang", "term")
              .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    return (counts.withColumn("n_lang", F.sum("n").over(term)).withColumn("docs", F.sum("docs").over(term))
            .withColumn("first", (F.row_number().over(term.orderBy("source")) == 1).cast("long"))
            .filter(F.col("docs") >= least_docs).drop("docs"))


def block_differences(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of terms, two blocks of sources: the bucket's part of each pair's value.

    Every source has a row without a term in each bucket, so that one without
    any of its terms is there too. In the bucket -1 that row has the vocabulary's size
    for a share, and the value is that of two sources without terms.
    """
    lang, bucket, low, high = (rows[c].iloc[0] for c in ("lang", "bucket", "low", "high"))
    source, names = pd.factorize(rows["source"], sort=False)
    names = np.asarray(names, object)
    block, absent = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    block[source], absent[source] = rows["block"].to_numpy(), rows["absent"].to_numpy(np.int64)
    share = rows["share"].to_numpy(np.int64)
    if bucket >= 0:
        term, terms = pd.factorize(rows["term"], sort=False)
        table = np.repeat(absent[:, None], len(terms), axis=1)
        table[source[term >= 0], term[term >= 0]] = share[term >= 0]
    left, right, out = np.flatnonzero(block == low), np.flatnonzero(block == high), ([], [], [])
    for a in left:
        b = right[[names[a] < names[x] for x in right]] if low == high else right
        if not len(b):
            continue
        base = np.abs(absent[a] - absent[b])
        value = share[source == a][0] * base if bucket < 0 else np.abs(table[a] - table[b]).sum(1) - len(terms) * base
        out[0].extend([names[a]] * len(b))
        out[1].extend(names[b])
        out[2].extend(value.tolist())
    return pd.DataFrame({"lang": lang, "a": pd.Series(out[0], dtype=object), "b": pd.Series(out[1], dtype=object), "value": np.asarray(out[2], np.int64)})


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources by difference, and each source's most over-used terms."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = materialise(kept_counts(docs, least_docs), "kept-terms")
    per_lang = kept.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_total"))
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    n_sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    stats = materialise(
        groups.join(per_group, ["lang", "source"], "left").join(n_sources, "lang").join(per_lang, "lang", "left")
        .na.fill(0, ["total", "terms", "lang_total"]).withColumn("absent", _share("0", "total")).withColumn("blocks", F.expr(f"(sources + {SOURCES - 1}) div {SOURCES}"))
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))), "source-stats")
    shares = kept.join(stats, ["lang", "source"]).withColumn("share", _share("n", "total"))
    # pairs
    buckets = F.expr(f"(terms + {TERMS - 1}) div {TERMS}")
    cells = shares.select("lang", "source", "block", "blocks", "absent", "term", "share", F.pmod(F.xxhash64("term"), buckets).alias("bucket"))
    whole = stats.select("lang", "source", "block", "blocks", "absent", F.lit(None).cast("string").alias("term"), F.col("terms").alias("share"),
                         F.explode(F.sequence(F.lit(-1).cast("long"), buckets - 1)).alias("bucket"))
    dealt = (cells.unionByName(whole).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks"))
    pairs = (dealt.groupBy("lang", "bucket", "low", "high").applyInPandas(block_differences, "lang string, a string, b string, value long")
             .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = pairs.withColumn("way", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    part_pairs = both.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(by_value))
    # terms
    over = (shares.withColumn("value", F.col("share") - _share("n_lang", "lang_total")).filter((F.col("n") > 0) & (F.col("value") > 0))
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    part_terms = over.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms)
    return part_pairs.unionByName(part_terms)
