"""Churn scoring on a stream of account snapshots.

New snapshot files that land in the source folder are scored micro-batch by
micro-batch with ``foreachBatch``:

* each batch is written to its own folder ``batch_id=<n>`` of the sink and
  replaces what an earlier try of the same batch left there, so a query that
  fails in the middle of a batch and is started again gives every row once;
* the model is looked up per batch: ``publish_model`` saves a new version next
  to the old ones and then moves the pointer ``CURRENT``; a running query
  scores its next batch with it, without a restart. Rows carry the version.

Progress lives in the checkpoint location and models in the model folder,
both on shared storage on a cluster.
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.churn import score
from ..session import scratch_path

POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish_model(spark: SparkSession, model: PipelineModel, models_path: str) -> int:
    """Save ``model`` as the next version under ``models_path`` and make it the
    current one. The pointer is replaced by a rename, after the model is whole."""
    root, fs = _files(spark, models_path)
    fs.mkdirs(root)
    taken = [int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v") and s.getPath().getName()[1:].isdigit()]
    version = max(taken, default=0) + 1
    model.write().save(os.path.join(models_path, f"v{version}"))
    fresh, _ = _files(spark, os.path.join(models_path, f".{POINTER}.{version}"))
    out = fs.create(fresh, True)
    out.write(bytearray(str(version).encode()))
    out.close()
    pointer, _ = _files(spark, os.path.join(models_path, POINTER))
    if fs.exists(pointer):
        fs.delete(pointer, False)
    fs.rename(fresh, pointer)
    return version


def current_version(spark: SparkSession, models_path: str) -> int | None:
    """The published version; None for a folder that is one saved model. While the pointer is being moved, the newest whole version."""
    pointer, fs = _files(spark, os.path.join(models_path, POINTER))
    if fs.exists(pointer):
        return int(spark.read.text(os.path.join(models_path, POINTER)).first()[0])
    root, _ = _files(spark, models_path)
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    waiting = [int(n.rsplit(".", 1)[1]) for n in names if n.startswith(f".{POINTER}.") and not n.endswith(".crc")]
    return max(waiting) if waiting else None


def load_current(spark: SparkSession, models_path: str) -> tuple[int, PipelineModel]:
    """(version, model) to score with now; a folder that is one saved model is version 0."""
    version = current_version(spark, models_path)
    return (0, PipelineModel.load(models_path)) if version is None else (version, PipelineModel.load(os.path.join(models_path, f"v{version}")))


def batch_scorer(models_path: str, sink_path: str, key: str = "account_id"):
    """The ``foreachBatch`` function: scores a batch with the current model and replaces the batch's folder of the sink."""
    known: dict[int, PipelineModel] = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = current_version(spark, models_path)
        if (version or 0) not in known:
            known.clear()
            number, model = load_current(spark, models_path)
            known[number] = model
        (number, model), = known.items()
        (score(model, batch).select(key, "churn_probability", "churn_prediction", F.lit(number).alias("model_version"))
         .write.mode("overwrite").parquet(os.path.join(sink_path, f"batch_id={batch_id}")))
    return run


def start_scoring(spark: SparkSession, model_path: str, source_path: str, schema: StructType,
                  sink_path: str, checkpoint: str | None = None, available_now: bool = True,
                  processing_time: str | None = None, key: str = "account_id", fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the scoring query. ``model_path`` is a folder of published versions
    or one saved model. With ``available_now`` it processes what is there and
    stops (batch-like back-fill); otherwise it runs on a processing-time trigger.
    The sink reads as one table with the columns batch_id and model_version."""
    ckpt = checkpoint or scratch_path(spark, os.path.join("streams", "churn_scoring"))
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    w = reader.load(source_path).writeStream.option("checkpointLocation", ckpt).foreachBatch(batch_scorer(model_path, sink_path, key))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()
