"""URL filters: prefix rules, and an exact block list as a Bloom filter cascade.

The key universe (every host of the corpus) is known, so a cascade of Bloom
filters can be exact on it: level 1 encodes the listed keys, level 2 the keys
of the universe that level 1 takes for listed by mistake, level 3 the listed
keys that level 2 takes for mistakes, and so on until no mistake is left. A
key's answer is the parity of the first level that does not hold it. Filters
are built by aggregation (bit_or per 64-bit word), and a page probes them by
array look-ups in a projection, without a join.

Defined results: a null url, or one without ``://``, has an empty host and
path and no rule, and its empty host is a key like any other; an empty list
blocks nothing; repeated pages are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import materialise

# Fixed values of the query contract: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Hosts with one of these words in a label are listed by the query.
BLOCKED_WORDS = ("adult", "bets", "casino", "pills", "porn", "spam")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def has_blocked_word(host: Column, words=BLOCKED_WORDS) -> Column:
    return host.rlike(r"(^|[.-])(" + "|".join(words) + r")($|[.-])")


def _places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits).cast("long")) for i in range(hashes)]


@dataclass
class Level:
    bits: int
    hashes: int
    table: DataFrame  # one row: words array<long>

    def holds(self, key: Column, level: int) -> Column:
        words, out = self.table.scalar(), F.lit(True)
        for place in _places(key, level, self.hashes, self.bits):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            out = out & (F.call_function("shiftright", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out


def _filter(keys: DataFrame, n: int, rate: float, level: int) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, -(-int(n * hashes / math.log(2) + 1) // 64) * 64)
    places = keys.select(F.explode(F.array(*_places(F.col("key"), level, hashes, bits))).alias("place"))
    one = places.groupBy(F.shiftright("place", 6).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))).alias("word"))
    words = keys.sparkSession.range(bits // 64).join(one, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    packed = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("words"))
    return Level(bits, hashes, materialise(packed, f"bloom{level}"))


class Cascade:
    """Exact membership of a key universe in a list.

    ``keys``: the universe, once each, as (key, listed). The filters' size
    follows the list (about 10 bits a listed key); beyond ``max_bytes`` the
    list is joined instead, as the filters are sent to every task.
    """

    def __init__(self, keys: DataFrame, max_bytes: int = 64 << 20):
        self.keys = materialise(keys.select("key", "listed"), "keys")
        self.levels: list[Level] = []
        sizes = {r[0]: r[1] for r in self.keys.groupBy("listed").count().collect()}
        inside, outside = self.keys.filter("listed"), self.keys.filter("not listed")
        n, others = sizes.get(True, 0), sizes.get(False, 0)
        rate = min(0.5, n / (math.sqrt(2) * others)) if others else 0.5
        self.fits = n * (2 - math.log2(rate)) * 1.5 / 8 * 1.5 <= max_bytes if n else True
        while self.fits and n:
            level = _filter(inside, n, rate, len(self.levels) + 1)
            self.levels.append(level)
            mistaken = materialise(outside.filter(level.holds(F.col("key"), len(self.levels))), "mistaken")
            inside, outside, n, rate = mistaken, inside, mistaken.count(), 0.5

    def mark(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """Adds the boolean ``name``: is the row's key listed?"""
        if not self.fits:
            listed = self.keys.filter("listed").select(F.col("key").alias("_listed_key"))
            return (rows.join(listed, rows[key] == F.col("_listed_key"), "left")
                    .withColumn(name, F.col("_listed_key").isNotNull()).drop("_listed_key"))
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[i - 1].holds(F.col(key), i), F.lit(i % 2 == 0)).otherwise(out)
        return rows.withColumn(name, out)


def judge_urls(pages: DataFrame, rules=RULES, blocked_words=BLOCKED_WORDS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, and whether its host is listed."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"),
                         path_of(F.col("url").cast("string")).alias("path"))
    hosts = parts.groupBy("host").agg(F.first(has_blocked_word(F.col("host"), blocked_words)).alias("listed"))
    marked = Cascade(hosts.withColumnRenamed("host", "key")).mark(parts, "host", "listed")
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return marked.select("page_id", "host", "path", text.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")
