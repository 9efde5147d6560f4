"""Stream scoring: a batch that is tried twice is there once; a new model version needs no restart."""

import time

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from retentia.streaming import scoring


def model(p):
    """A stand-in for a fitted churn pipeline that scores every row with p."""
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {p}D AS probability_1 FROM __THIS__")])


def rows(spark, path, name, ids):
    spark.createDataFrame([(i,) for i in ids], "account_id long").coalesce(1).write.parquet(str(path / name))
    return str(path / "*")


def test_retried_batch_leaves_no_duplicates(spark, tmp_path, monkeypatch):
    scoring.publish_model(spark, model(0.25), str(tmp_path / "models"))
    source = rows(spark, tmp_path / "in", "a", range(10))
    schema = spark.read.parquet(str(tmp_path / "in" / "a")).schema
    args = (spark, str(tmp_path / "models"), source, schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    make = scoring.batch_scorer

    def failing(*a):
        run = make(*a)

        def broken(batch, batch_id):
            run(batch, batch_id)
            raise RuntimeError("lost after writing")
        return broken
    monkeypatch.setattr(scoring, "batch_scorer", failing)
    with pytest.raises(Exception, match="lost after writing"):
        scoring.start_scoring(*args).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10  # written, not committed
    monkeypatch.setattr(scoring, "batch_scorer", make)
    scoring.publish_model(spark, model(0.75), str(tmp_path / "models"))
    scoring.start_scoring(*args).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.account_id for r in got) == list(range(10))
    assert {(r.model_version, r.churn_probability, r.churn_prediction, r.batch_id) for r in got} == {(2, 0.75, 1, 0)}  # the whole batch anew
    scoring.start_scoring(*args).awaitTermination(120)  # nothing new: nothing scored again
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_new_model_is_picked_up_by_a_running_query(spark, tmp_path):
    assert scoring.publish_model(spark, model(0.25), str(tmp_path / "models")) == 1
    source = rows(spark, tmp_path / "in", "a", range(5))
    schema = spark.read.parquet(str(tmp_path / "in" / "a")).schema
    q = scoring.start_scoring(spark, str(tmp_path / "models"), source, schema, str(tmp_path / "out"), str(tmp_path / "ck"),
                              available_now=False, processing_time="200 milliseconds")
    try:
        def wait(n):
            for _ in range(300):
                if q.exception():
                    raise q.exception()
                if (tmp_path / "out" / f"batch_id={n}" / "_SUCCESS").exists():
                    return
                time.sleep(0.2)
            raise AssertionError("no batch")
        wait(0)
        assert scoring.publish_model(spark, model(0.75), str(tmp_path / "models")) == 2
        rows(spark, tmp_path / "in", "b", range(5, 9))
        wait(1)
    finally:
        q.stop()
    got = {r.account_id: (r.model_version, r.churn_probability) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: (1, 0.25) if i < 5 else (2, 0.75) for i in range(9)}


def test_one_saved_model_is_version_zero(spark, tmp_path):
    model(0.5).write().save(str(tmp_path / "m"))
    version, loaded = scoring.load_current(spark, str(tmp_path / "m"))
    assert version == 0 and loaded.transform(spark.range(1)).first().probability_1 == 0.5
