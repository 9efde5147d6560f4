"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC dates (the tables carry naive timestamps),
# AQE for runtime re-planning (small-side broadcast, partition coalescing,
# skew-join splitting) and ANSI arithmetic (division by zero must be guarded).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "retentia", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session. On a cluster pass master=None and let
    spark-submit decide; locally ``local[N]`` with N shuffle partitions."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    # model fitting and cross-validation submit jobs from several threads at
    # once; FAIR scheduling interleaves them instead of queueing whole jobs
    conf["spark.scheduler.mode"] = "FAIR"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "8g")
        conf.setdefault("spark.ui.enabled", "false")
        conf.setdefault("spark.ui.showConsoleProgress", "false")
        # one JVM: every block is process-local, waiting for locality buys nothing
        conf.setdefault("spark.locality.wait", "0s")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session someone else built."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object-store) folder there and we use it
    as is. Only in local mode may it be unset; we then pick a scratch folder.
    Elsewhere that is an error, as executors do not see the driver's disk.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="retentia-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder, a new one on every call."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def write_once(df, name: str = "table"):
    """``df`` written as Parquet to the shared folder and read again: later
    branches prune columns and survive executor loss. Select what they need
    first."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df) -> None:
    """Remove a table of ``write_once`` that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session: the tree
    passes run numpy there and a cluster may not have the package installed."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_retentia_code", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="retentia-code-"), "retentia_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("retentia", os.path.relpath(path, top)))
    sc.addPyFile(at)
    sc._retentia_code = True


def default_parallelism(spark: SparkSession, fallback: int = 8) -> int:
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 -- Spark Connect
        return fallback


def reliable_checkpoint(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder
    (never ``localCheckpoint``: executor-local blocks die with the executor).

    The input is persisted first: an eager checkpoint otherwise computes its
    plan twice (once to count, once to write the files)."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


def sizing(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a job that reads about ``input_bytes``: shuffle
    partitions so each holds about ``target_partition_bytes`` before AQE
    coalesces them, the same size for scan splits and AQE's advisory size."""
    parts = max(1, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
