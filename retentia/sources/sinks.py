"""Writers for result tables, one-row JSON records and fitted models.

Every result is a DataFrame and is written by Spark's writers -- no driver
side files. Paths may be local folders in tests or shared storage on a
cluster.
"""

from __future__ import annotations

import os
import re

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """A result table as Parquet (default) or CSV with a header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_record(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A one-row summary (nested structs/arrays allowed) as JSON. The
    frame is a single row, so one output file is written."""
    df.coalesce(1).write.mode(mode).json(path)
    return path


def save_model(model: PipelineModel, path: str) -> str:
    """Persist a fitted pipeline (preprocessing + classifier)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# Buckets of the co-located tables: about 100 GB of a table each 100 MB; a power of two, so that fewer can be read as groups.
BUCKETS = 1024


def write_bucketed(df: DataFrame, table: str, key: str, path: str | None = None, buckets: int = BUCKETS) -> str:
    """A catalog table bucketed and sorted by ``key``: aggregations by the key
    and joins of such tables on it are planned without an exchange. The rows are dealt out
    by the key first, so that each bucket is one file. ``path`` keeps the files outside the warehouse."""
    w = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (w.option("path", path) if path else w).saveAsTable(table)
    return table


def write_account_tables(tables, prefix: str, path: str | None = None, buckets: int = BUCKETS):
    """The star schema as tables co-located by account: usage rows get their
    account here, once, instead of in every analysis. Returns what ``read_account_tables`` returns."""
    from ..operators.features import usage_with_account

    if not re.fullmatch(r"\w+(\.\w+)?", prefix):
        raise ValueError(f"not a table name: {prefix}")
    spark = tables.accounts.sparkSession
    frames = {"accounts": tables.accounts, "subscriptions": tables.subscriptions,
              "usage": usage_with_account(tables.usage, tables.subscriptions), "tickets": tables.tickets, "churn": tables.churn}
    for name, df in frames.items():
        write_bucketed(df, f"{prefix}_{name}", "account_id", os.path.join(path, name) if path else None, buckets)
    return read_account_tables(spark, prefix, tables.reference_date)


def read_account_tables(spark: SparkSession, prefix: str, reference_date):
    """The co-located tables as ``SubscriptionTables``: Customer-360 and the account joins read them without an exchange."""
    from .tables import SubscriptionTables

    return SubscriptionTables(*[spark.table(f"{prefix}_{n}") for n in ("accounts", "subscriptions", "usage", "tickets", "churn")],
                              reference_date=reference_date)
