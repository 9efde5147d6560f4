"""Exact median without gathering a group into one task.

Spark's exact ``median``/``percentile`` keeps a value->count map of the whole
group in one aggregation buffer, which is unbounded for continuous values and a
hot group. Here rows are first reduced to counts per (group, value) -- partial
on the map side, and spread by value, never by the group alone. The values are
cut into ranges; counts per (group, range) locate the range that holds a
group's middle ranks, and only inside those ranges are values ranked.

The even-n median is (a + b) / 2 of the two middle values, the definition
NumPy/pandas use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_once
from .ordered import range_buckets


def exact_median(df: DataFrame, value: str, by: list[str] | None = None, name: str = "median") -> DataFrame:
    """One row per group of ``by`` (or one row) with the exact median of the
    non-null values of ``value`` (as DOUBLE) in column ``name``. Groups
    without a non-null value are absent."""
    by = list(by or [])
    counts = (df.select(*by, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
              .groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c")))
    counts = range_buckets(write_once(counts, "value-counts"), "_x")
    # one row per group and range
    per = counts.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_in"))
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    per = per.withColumns({"_end": F.sum("_in").over(upto), "_n": F.sum("_in").over(all_)})
    k_lo, k_hi = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    before = F.col("_end") - F.col("_in")
    holds = lambda k: (before <= k) & (k < F.col("_end"))
    middle = per.where(holds(k_lo) | holds(k_hi)).select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_bucket").alias("_mb"), before.alias("_before"), "_n")
    same = F.col("_bucket") == F.col("_mb")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    found = counts.join(middle, same).drop("_mb", *[f"_g_{c}" for c in by])
    w = Window.partitionBy(*by, "_bucket").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = found.withColumn("_upto", F.col("_before") + F.sum("_c").over(w))
    at = lambda k: F.max(F.when((F.col("_upto") - F.col("_c") <= k) & (k < F.col("_upto")), F.col("_x")))
    res = ranked.groupBy(*by).agg(at(k_lo).alias("_a"), at(k_hi).alias("_b"))
    if not by:
        res = res.where(F.col("_a").isNotNull())
    return res.select(*by, ((F.col("_a") + F.col("_b")) / 2.0).alias(name))
