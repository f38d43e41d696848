"""Tables that a stream extends by one numbered folder a batch, and their folding into snapshots.

``batch=N`` holds what batch N added, ``upto=N`` a snapshot of all batches up to N. A reader takes the newest snapshot and
the batches after it, so a batch that is repeated after its folder was folded in changes nothing. Folding keeps the snapshot
before, with the batches after that, for readers that have begun with it, and removes what is older.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _named(spark: SparkSession, path: str, prefix: str) -> list:
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath() for s in files.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith(f"{prefix}=")]
    return [(int(p.getName().split("=")[1]), p) for p in names]


def numbers(spark: SparkSession, path: str, prefix: str, above: int | None = None) -> list[int]:
    """Numbers of the complete sub-folders ``prefix=N`` over ``above``. A folder counts once it has Spark's success mark;
    only those over ``above`` are asked for it."""
    _, files = _folder(spark, path)
    wanted = [(n, p) for n, p in _named(spark, path, prefix) if above is None or n > above]
    return sorted(n for n, p in wanted if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def remove(spark: SparkSession, path: str, prefix: str, upto: int) -> None:
    """Delete the sub-folders ``prefix=N`` up to a number."""
    _, files = _folder(spark, path)
    for number, folder in _named(spark, path, prefix):
        if number <= upto:
            files.delete(folder, True)


def write_part(rows: DataFrame, path: str, number: int) -> None:
    """What a batch adds. A repeated batch replaces its own folder."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def _read(spark: SparkSession, path: str, below: int | None) -> tuple[DataFrame | None, list[int], int | None]:
    upto = (numbers(spark, path, "upto") or [None])[-1]
    later = [n for n in numbers(spark, path, "batch", upto) if below is None or n < below]
    rows = None if upto is None else spark.read.parquet(f"{path}/upto={upto}").withColumn("batch", F.lit(upto))
    if later:
        added = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in later])
        rows = added if rows is None else rows.unionByName(added, allowMissingColumns=True)
    return rows, later, upto


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot and all batches after it, with the number of the ``batch``; the snapshot's rows have its own."""
    rows, _, _ = _read(spark, path, None)
    if rows is None:
        raise ValueError(f"No complete batch in {path}")
    return rows


def fold(spark: SparkSession, path: str, combine: Callable[[DataFrame], DataFrame], below: int | None = None) -> None:
    """Write a snapshot of all batches (those under ``below``), made by ``combine`` from what ``read_parts`` gives."""
    rows, later, upto = _read(spark, path, below)
    if later:
        combine(rows).drop("batch").write.mode("overwrite").parquet(f"{path}/upto={later[-1]}")
        if upto is not None:
            remove(spark, path, "batch", upto)
            remove(spark, path, "upto", upto - 1)


def save_part(path: str, part: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame], DataFrame], every: int):
    """``foreachBatch`` function: writes each batch's part and folds those before it at each ``every``-th batch. All of them are
    committed by then, so none is written again, and there are never more than a few times ``every`` folders."""

    def save(batch: DataFrame, number: int) -> None:
        if number and number % every == 0:
            fold(batch.sparkSession, path, combine, below=number)
        write_part(part(batch), path, number)

    return save
