"""Session set-up and the shared work folder."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on. Cluster sizes (executors, memory) belong to spark-submit, not here.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.python.filterPushdown.enabled": "true",
    # stream state on disk, so that it may outgrow an executor's memory
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else started."""
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "ledgerloom") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site lookup per column
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, for a cluster on which it is not installed."""
    package = os.path.dirname(os.path.abspath(__file__))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="ledgerloom-code-"), "ledgerloom"), "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(made)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder for one run's intermediate tables and stream checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary
    folder that goes when the process ends; on a cluster it is an error, because executors would each write to their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_folder()
    path = f"{base.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def clear_work(spark: SparkSession) -> None:
    """Delete the work folders that this process has made. Call it when their tables are no longer read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    while _made:
        path = hadoop.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reliable_checkpoint(df, name: str = "cut"):
    """Cut lineage with a written table in the shared folder, so a lost executor costs a re-read only."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
