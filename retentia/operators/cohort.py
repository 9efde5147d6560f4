"""Monthly signup-cohort retention.

An account counts in month k of its cohort when one of its subscriptions
*starts* k calendar months after the signup month. The heavy work is one
join (subscriptions -> account signup month) and one distinct count per
(cohort, month) cell; everything after that runs on the cell table, whose
size is bounded by months x months, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import month_index, month_label, pct_half_up
from ..session import reliable_checkpoint


def _cells(subs: DataFrame, accounts: DataFrame) -> DataFrame:
    """(signup_month DATE, cohort_index, active_accounts) for index >= 0."""
    acc = accounts.select("account_id", F.trunc("signup_date", "MM").alias("signup_month"))
    s = subs.select("account_id", F.trunc("start_date", "MM").alias("start_month"))
    j = s.join(acc, "account_id", "inner")
    j = j.withColumn("cohort_index", month_index("start_month", "signup_month"))
    # index >= 0 depends on both join sides, so it stays after the join.
    # Distinct accounts per cell: de-duplicate (cell, account) first -- a
    # partial aggregation on the map side -- then count.
    return (j.where(F.col("cohort_index") >= 0)
            .select("signup_month", "cohort_index", "account_id").distinct()
            .groupBy("signup_month", "cohort_index")
            .agg(F.count(F.lit(1)).alias("active_accounts")))


def cohort_retention(subs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Script version (C1, V2): the base of a cohort is its count in the first
    index column of the matrix (the smallest index present in any cohort,
    normally 0); a cohort without that index has no base (NULL percentages).
    retention_pct = 100 * active / base rounded half-up at one decimal."""
    # the cell table (bounded by months x months) is read twice below: it is
    # materialised once instead of re-running the join and distinct count
    cells = reliable_checkpoint(_cells(subs, accounts))
    # min over the cell table: a one-row aggregate of a small table
    first_idx = cells.agg(F.min("cohort_index").alias("_first"))
    base = (cells.crossJoin(F.broadcast(first_idx))
            .where(F.col("cohort_index") == F.col("_first"))
            .select("signup_month", F.col("active_accounts").alias("base_accounts")))
    out = cells.join(base, "signup_month", "left")
    return out.select(
        month_label("signup_month").alias("signup_cohort"),
        "cohort_index", "active_accounts", "base_accounts",
        pct_half_up("active_accounts", "base_accounts", 1).alias("retention_pct"),
    )


def cohort_matrix(long: DataFrame, indices: list[int], label: str = "signup_cohort",
                  value: str = "retention_pct") -> DataFrame:
    """Wide matrix: one row per cohort, one column ``m<k>`` per cohort index.
    The index list is passed explicitly, so Spark runs no extra distinct job."""
    wide = long.groupBy(label).pivot("cohort_index", indices).agg(F.first(value))
    return wide.select(label, *[F.col(str(i)).alias(f"m{i}") for i in indices])


def cohort_retention_active(subs: DataFrame, accounts: DataFrame, max_cohorts: int | None = None,
                            max_index: int | None = None) -> DataFrame:
    """Notebook version (C2, V3): only subscriptions with churn_flag false;
    base = all accounts of the signup month; ``max_cohorts`` and
    ``max_index`` keep the first cohorts (in month order, among cohorts with a
    cell) and the first indices present (the notebook shows 12 x 12). Long form; retention_pct = 100 * active / size."""
    active = subs.where(~F.col("churn_flag"))
    cells = _cells(active, accounts)
    sizes = (accounts.select(F.trunc("signup_date", "MM").alias("signup_month"), "account_id")
             .groupBy("signup_month").agg(F.countDistinct("account_id").alias("cohort_size")))
    j = cells.join(sizes, "signup_month", "inner")
    # ranks over the cell table (bounded by months x months rows)
    cohort_rank = F.dense_rank().over(Window.orderBy("signup_month"))
    index_rank = F.dense_rank().over(Window.orderBy("cohort_index"))
    ranked = j.withColumn("_cr", cohort_rank).withColumn("_ir", index_rank)
    kept = ranked
    for rank, most in (("_cr", max_cohorts), ("_ir", max_index)):
        kept = kept.where(F.col(rank) <= most) if most else kept
    return kept.select(
        month_label("signup_month").alias("signup_month"),
        "cohort_index", "active_accounts", "cohort_size",
        (F.col("active_accounts").cast("double") / F.col("cohort_size").cast("double") * 100.0)
        .alias("retention_pct"),
    )
