"""Account-bucketed tables: the same matrix, planned without an exchange."""

import re

import pytest

from retentia.operators import features as feat
from retentia.sources import sinks
from retentia.sources import tables as src


@pytest.fixture(scope="module")
def stored(spark, sf_small, tmp_path_factory):
    names = sinks.write_account_tables(src.load_tables(spark, sf_small), "colocated", str(tmp_path_factory.mktemp("colocated")), buckets=4)
    yield names
    for n in ("accounts", "subscriptions", "usage", "tickets", "churn"):
        spark.sql(f"DROP TABLE colocated_{n}")


def test_same_customer_360(spark, sf_small, stored):
    a = feat.customer_360(stored).orderBy("account_id").collect()
    b = feat.customer_360(src.load_tables(spark, sf_small)).orderBy("account_id").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b] and len(a) == 150


def test_no_exchange_above_the_bucketed_scans(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = feat.customer_360(stored)._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"SortMergeJoin", plan)
        # the only exchange gathers the one row of global fill values, which is then broadcast
        exchanges = re.findall(r"(?<!Broadcast)Exchange (\w+)", plan)
        assert len(joins) == 4 and exchanges == ["SinglePartition"], plan
        usual = feat.subscription_features(stored.subscriptions)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in usual and "SelectedBucketsCount" in usual or "Bucketed: true" in usual
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_table_names_are_checked(spark, sf_small):
    with pytest.raises(ValueError):
        sinks.write_account_tables(src.load_tables(spark, sf_small), "a; DROP")
