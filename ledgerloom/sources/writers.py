"""Sinks. All write through Spark tasks; nothing passes the driver."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_training_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Day-partitioned table, rows of a file ordered by user and category.

    ``rebalance`` sizes the files at run time and splits a day that holds a large share of the rows."""
    (
        df.withColumn("date_day", F.to_date("date"))
        .hint("rebalance", "date_day")
        .sortWithinPartitions("date_day", "user_id", "category")
        .write.mode(mode)
        .partitionBy("date_day")
        .parquet(path)
    )


def read_training_table(spark: SparkSession, path: str, schema: T.StructType | None = None, since: Column | None = None) -> DataFrame:
    """The table with columns that later appends added, from the day ``since`` on (only those partitions are read).

    With a ``schema`` no file footer is opened to find the columns."""
    if schema is not None:
        table = spark.read.schema(T.StructType([*schema.fields, T.StructField("date_day", T.DateType())])).parquet(path)
    else:
        table = spark.read.option("mergeSchema", "true").parquet(path)
    return (table if since is None else table.filter(F.col("date_day") >= since)).drop("date_day")


def write_training_files(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Snappy Parquet files of limited length for training."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").parquet(path)


def write_snapshot(df: DataFrame, path: str, run_id: str) -> str:
    """One snapshot in its own folder; returns the folder."""
    target = f"{path.rstrip('/')}/run_id={run_id}"
    df.write.mode("errorifexists").option("compression", "snappy").parquet(target)
    return target


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def drop_partitions(spark: SparkSession, path: str, column: str, wanted: Callable[[str], bool]) -> list[str]:
    """Delete the partition folders of a table whose value is ``wanted``; returns their values. No file is read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for status in files.listStatus(folder) if files.exists(folder) else []:
        name, _, value = status.getPath().getName().partition("=")
        if status.isDirectory() and name == column and wanted(value):
            files.delete(status.getPath(), True)
            dropped.append(value)
    return sorted(dropped)


def drop_days_before(spark: SparkSession, path: str, column: str, day: datetime.date) -> list[str]:
    """Retention by whole partitions: delete the folders of the days before ``day``. Others keep their files."""
    return drop_partitions(spark, path, column, lambda value: value < day.isoformat() and not value.startswith("__"))


def replace_days(df: DataFrame, path: str, column: str) -> None:
    """Overwrite only the day partitions that occur in ``df``."""
    (
        df.withColumn("date_day", F.to_date(column))
        .hint("rebalance", "date_day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date_day")
        .parquet(path)
    )
