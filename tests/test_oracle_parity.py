"""Every query with an oracle: Spark result == DuckDB result (sf0.001)."""
import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "date": "DATE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf_small, con, name):
    sdf = E.queries()[name](spark, sf_small)
    rel = con.sql(ORACLE[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in sdf.schema.fields:
        st = f.dataType.simpleString()
        assert TYPE_NAMES.get(st, st) == duck_types.get(f.name), (f.name, st, duck_types.get(f.name))
    sp = sdf.toPandas()
    dp = rel.df()
    r = compare(sp, dp)
    assert r["cols_match"], r
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r["exact"], r


def test_every_query_has_a_callable_and_oracle_keys_are_queries():
    qs = E.queries()
    assert set(ORACLE) <= set(qs)
    assert len(qs) >= 55


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 150
    assert len(df.columns) == 49
