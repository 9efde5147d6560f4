import random

import duckdb
from pyspark.sql import functions as F

from retentia.llm.queries import ORACLE, QUERIES
from retentia.llm.url_filter import Cascade, judge_urls


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    expected = con.execute(ORACLE["op6_url_filters"]).fetchall()
    got = [tuple(r) for r in QUERIES["op6_url_filters"](spark, d).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and got


def test_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://Example.com/en/", "http://example.com", "http://notexample.com/en/",
            "ftp://a.net/fr/://b/es/", "http://x.net?/es/", "http://x.net/es", "http://Ä.net/es/", "a\nb://spam-farm.org/q\nr#f", "http://my.adult-x.org", "http://y.org/adult"]
    pages = spark.createDataFrame([(i, u, "h", "k", 1) for i, u in enumerate(urls)] + [(None, urls[4], "h", "k", 1), (4, urls[4], "h", "k", 1)],
                                  "page_id long, url string, host string, listed string, path int")
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages).collect()}
    assert got[0] == ("", "", None, "allow", False) == got[1] == got[2]
    assert got[3] == ("", "", None, "allow", False)
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow", False) == got[None]
    assert got[5][2:4] == ("example.com/en/", "block") and got[6][2:4] == (None, "allow") and got[7][2:4] == ("com/", "allow")
    assert got[8] == ("a.net", "/fr/://b/es/", "net/fr/", "block", False)
    assert got[9][:4] == ("x.net", "", None, "allow") and got[10][2] is None and got[11][:3] == ("Ä.net", "/es/", "net/es/")
    assert got[12] == ("spam-farm.org", "/q\nr", None, "block", True) and got[13][3] == "block" and got[14][3] == "allow"
    assert judge_urls(pages).count() == len(urls) + 2 and judge_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    r = random.Random(1)
    keys = [(f"host{i}.org", r.random() < 0.04) for i in range(20000)]
    df = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = Cascade(df)
    assert len(cascade.levels) >= 2
    assert cascade.mark(df, "key", "said").filter(F.col("said") != F.col("listed")).count() == 0
    joined = Cascade(df, max_bytes=0)
    assert not joined.levels and joined.mark(df, "key", "said").filter(F.col("said") != F.col("listed")).count() == 0
    for none in (True, False):
        same = df.withColumn("listed", F.lit(none))
        assert Cascade(same).mark(same, "key", "said").filter(F.col("said") != none).count() == 0


def test_plan_has_no_python_and_no_join(spark):
    plan = QUERIES["op6_url_filters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
