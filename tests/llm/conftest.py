import os

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, n_words string, block int, word long, line string"


@pytest.fixture(scope="session", autouse=True)
def _code(spark):
    from retentia.llm.common import ship_code
    ship_code(spark)


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text) pairs, with columns whose names clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", None, "x", "y", 1, 2, "z") for i, t in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def small_texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{os.path.join(SMALL, 'documents.parquet')}'").fetchall())


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
