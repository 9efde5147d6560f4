"""Order-dependent reductions without a single-partition window.

A window with ORDER BY but no PARTITION BY moves every row into one task.
These helpers cut the ordering key into contiguous ranges (buckets), run the
window inside each range in parallel, and stitch the ranges together with a
small per-bucket table (one row per bucket).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_once


# Rows that one range holds: the number of ranges follows the table.
ROWS_PER_RANGE = 100_000


def range_count(rows: int, per: int = ROWS_PER_RANGE) -> int:
    return max(1, -(-rows // per))


def range_buckets(df: DataFrame, order_col: str, buckets: int | None = None,
                  accuracy: int = 10_000) -> DataFrame:
    """Adds ``_bucket``: a non-decreasing function of the numeric
    ``order_col`` that splits the rows into about ``buckets`` contiguous
    ranges of similar size (by default one per ROWS_PER_RANGE rows). Split
    points come from a ``percentile_approx`` sketch whose accuracy follows the
    number of ranges; a ``Bucketizer`` places each row by binary search."""
    buckets = buckets or range_count(df.count())
    probs = [i / buckets for i in range(1, buckets)]
    points = []
    if probs:
        row = df.agg(F.percentile_approx(F.col(order_col).cast("double"), probs, max(accuracy, 20 * buckets)).alias("s")).first()
        points = sorted({float(v) for v in (row["s"] or []) if v is not None and v == v})
    splits = [-float("inf")] + [p for p in points if p not in (float("inf"), -float("inf"))] + [float("inf")]
    t = df.withColumn("_okey", F.col(order_col).cast("double"))
    if len(splits) == 2:
        return t.withColumn("_bucket", F.lit(0)).drop("_okey")
    t = Bucketizer(splits=splits, inputCol="_okey", outputCol="_b", handleInvalid="keep").transform(t)
    return t.withColumn("_bucket", F.col("_b").cast("int")).drop("_okey", "_b")


def running_sums(df: DataFrame, order_col: str, value_cols: list[str],
                 buckets: int | None = None, inclusive: bool = True) -> DataFrame:
    """Adds ``cum_<v>`` = sum of ``v`` over all rows ordered before (and,
    with ``inclusive``, including) the row, for a table whose ``order_col``
    values are distinct. Work is split into range buckets: in-bucket window
    plus the bucket's offset from a per-bucket table."""
    t = range_buckets(df, order_col, buckets)
    per_b = t.groupBy("_bucket").agg(*[F.sum(v).alias(f"_bt_{v}") for v in value_cols])
    wb = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_b.select("_bucket", *[F.coalesce(F.sum(f"_bt_{v}").over(wb), F.lit(0)).alias(f"_off_{v}")
                                     for v in value_cols])
    # one row per range, ROWS_PER_RANGE times fewer than the table
    t = t.join(offs, "_bucket")
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    w = Window.partitionBy("_bucket").orderBy(order_col).rowsBetween(*frame)
    for v in value_cols:
        t = t.withColumn(f"cum_{v}", F.col(f"_off_{v}") + F.coalesce(F.sum(v).over(w), F.lit(0)))
    return t.drop("_bucket", *[f"_off_{v}" for v in value_cols])


def ranged(df: DataFrame, order_col: str, name: str = "ordered") -> DataFrame:
    """``df`` written once, with ``_bucket``: the table that ``range_scan`` reads in
    several branches. A table of one range has no ``_bucket``, as there is nothing to stitch."""
    own = write_once(df, name)
    ranges = range_count(own.count())
    return own if ranges == 1 else range_buckets(own, order_col, ranges)


def range_scan(t: DataFrame, by: list[str], order_col: str, specs: list[tuple[str, str, str]], descending: bool = False,
               inclusive: bool = True) -> DataFrame:
    """Segmented running sums and products: adds each ``out`` of (out, column,
    'sum' or 'product'), over the rows of the same ``by`` that come before (and
    including) the row. A group of any number of rows is cut into the ranges of
    ``_bucket``: a window inside each (group, range), combined with what the group's
    earlier ranges come to, from a table of one row per group and range."""
    neutral = {"sum": F.lit(0), "product": F.lit(1.0)}
    total = {"sum": F.sum, "product": F.product}

    def combine(kind, a, b):
        return a + b if kind == "sum" else a * b
    order = F.desc if descending else F.asc
    if "_bucket" not in t.columns:
        alone = Window.partitionBy(*by).orderBy(order(order_col)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        for out, c, kind in specs:
            t = t.withColumn(out, F.coalesce(total[kind](c).over(alone), neutral[kind]))
        return t
    earlier = Window.partitionBy(*by).orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = t.groupBy(*by, "_bucket").agg(*[total[kind](c).alias(f"_t_{out}") for out, c, kind in specs]).select(
        *by, "_bucket", *[F.coalesce(total[kind](f"_t_{out}").over(earlier), neutral[kind]).alias(f"_o_{out}") for out, _, kind in specs])
    inside = Window.partitionBy(*by, "_bucket").orderBy(order(order_col)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = t.join(offsets, [*by, "_bucket"])
    for out, c, kind in specs:
        joined = joined.withColumn(out, combine(kind, F.col(f"_o_{out}"), F.coalesce(total[kind](c).over(inside), neutral[kind])))
    return joined.drop(*[f"_o_{out}" for out, _, _ in specs])


def successive_diff_sq_sum(df: DataFrame, order_col: str, value_col: str) -> float:
    """sum_t (v_t - v_{t-1})^2 over rows ordered by ``order_col`` (the
    Durbin-Watson numerator), for a key of any orderable type. The rows are
    range-partitioned on the key in its own type; differences inside a
    partition come from ``lag``, the pair that straddles two partitions from
    their first and last rows. Returns a float (one aggregated value)."""
    own = write_once(df.select(F.col(order_col).alias("_k"), F.col(value_col).alias("_v")), "ordered")
    own = own.repartitionByRange(range_count(own.count()), "_k").withColumn("_bucket", F.spark_partition_id())
    t = write_once(own, "ranges")  # partition numbers are fixed once written
    inner = t.withColumn("_d", F.col("_v") - F.lag("_v").over(Window.partitionBy("_bucket").orderBy("_k")))
    inside = inner.agg(F.sum(F.col("_d") ** 2).alias("s")).first()["s"] or 0.0
    ends = t.groupBy("_bucket").agg(F.min_by("_v", "_k").alias("_first"), F.max_by("_v", "_k").alias("_last"))
    cross = (ends.withColumn("_prev_last", F.lag("_last").over(Window.orderBy("_bucket")))
             .agg(F.sum((F.col("_first") - F.col("_prev_last")) ** 2).alias("s")).first()["s"] or 0.0)
    return float(inside) + float(cross)
