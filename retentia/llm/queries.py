"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retentia.llm import (
    align,
    decontaminate,
    divergence,
    jaccard_join,
    line_dedup,
    lm_score,
    maxscore,
    packing,
    quality_cnn,
    quality_rules,
    substring_dedup,
    toxicity,
    url_filter,
)
from retentia.llm.common import ship_code, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cover half of a test item or more, with the item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 2048, 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that goes, with the earlier line that it repeats."""
    return line_dedup.removed_lines(table(spark, sf_dir, "documents")).drop("_key")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document in a byte-level and a piece vocabulary."""
    return align.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language by word use, and each source's most over-used terms."""
    return divergence.audit(table(spark, sf_dir, "documents"), 30, 50)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector."""
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), 5, 50)


def _shipped(fn: Callable) -> Callable:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return fn(spark, sf_dir)
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {fn.__name__: _shipped(fn) for fn in (
    op1_benchmark_decontamination, op2_quality_rules, op3_best_fit_packing, op4_line_dedup, op5_lm_scoring,
    op6_url_filters, op7_substring_dedup, op8_ngram_jaccard_join, op9_quality_classifier, op10_toxicity,
    op11_cross_tokenizer_alignment, op12_source_divergence, op13_exact_top_k,
)}

ORACLE: dict[str, str] = {
    "op6_url_filters": r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ruled AS (
  SELECT *, regexp_matches(host, '(^|[.-])(adult|bets|casino|pills|porn|spam)($|[.-])') AS listed,
         CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
terms AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x60\x7B-\x7F]+')) AS term FROM d),
per_doc AS (SELECT id, lang, source, term, count(*) AS c FROM terms GROUP BY ALL),
per_lang AS (SELECT lang, term, sum(c) AS c FROM per_doc GROUP BY lang, term HAVING count(*) >= 30),
per_source AS (SELECT lang, source, term, sum(c) AS c FROM per_doc SEMI JOIN per_lang USING (lang, term) GROUP BY lang, source, term),
sources AS (SELECT DISTINCT lang, source FROM d),
vocabulary AS (SELECT lang, count(*) AS v, sum(c) AS n FROM per_lang GROUP BY lang),
totals AS (SELECT lang, source, sum(c) AS n FROM per_source GROUP BY lang, source),
shares AS (
  SELECT s.lang, s.source, l.term, coalesce(p.c, 0) AS c,
         (1 + (1000000000::HUGEINT * (coalesce(p.c, 0)::HUGEINT + 5)) // (coalesce(t.n, 0)::HUGEINT + 5 * v.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (l.c::HUGEINT + 5)) // (v.n::HUGEINT + 5 * v.v))::BIGINT AS q
  FROM sources s JOIN per_lang l USING (lang) JOIN vocabulary v USING (lang)
  LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source
  LEFT JOIN per_source p ON p.lang = s.lang AND p.source = s.source AND p.term = l.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 50""",
    "op13_exact_top_k": r"""
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.id, q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.id <> d.id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 5""",
}
