"""Structured Streaming jobs. They call the same expressions as the batch jobs.

The reading position and the state live in the checkpoint folder, so a job that stops anywhere goes on where
it was. The ledger is kept as numbered snapshots with one pointer row, and a repeated batch writes the same
snapshot number again.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schemas
from ..operators import extraction, ledger, rules
from ..operators.common import latest_by
from . import parts

COUNTED = ["user_id", "transaction_id", "user_category", "predicted_category", "last_modified"]


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def message_stream(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    return read_stream(spark, path, schemas.struct(schemas.MESSAGE_DDL), fmt, files_per_trigger)


def run_stream(writer: DataStreamWriter, checkpoint: str, once: bool, interval: str):
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


# --------------------------------------------------------------------------------------------- extraction


def extract(messages: DataFrame, as_of, templates=None) -> DataFrame:
    """Parsed messages as a stream; ``parse_status`` tells transactions from quarantine."""
    return extraction.parse_messages(messages, as_of, templates)


def start_extract(messages: DataFrame, as_of, out: str, checkpoint: str, once: bool = True, interval: str = "10 minutes"):
    """Append parsed messages to ``out``, partitioned into transactions and quarantine.

    A message without a date gets ``as_of``, or without that the time at which its batch runs; a repeated batch replaces
    its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        now = as_of or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
        extract(batch, now).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("parse_status").parquet(f"{out}/batch={number}")

    return run_stream(messages.writeStream.foreachBatch(save), checkpoint, once, interval)


def start_unique(rows: DataFrame, out: str, checkpoint: str, key: str = "transaction_id", once: bool = True, interval: str = "10 minutes", every: int = 20):
    """Collect a stream whose rows may repeat, at any distance in time. Each batch is written with one row per key;
    ``read_unique`` keeps the first batch's row. There is no watermark, so no row is too late, and no state that grows;
    at each ``every``-th batch the ones before are folded into one. ``late.start_unique_within`` drops copies as they come."""
    save = parts.save_part(out, lambda batch: batch.dropDuplicates([key]), lambda rows: _first_of_each(rows, key), every)
    return run_stream(rows.writeStream.foreachBatch(save), checkpoint, once, interval)


def _first_of_each(rows: DataFrame, key: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.col("batch")).alias("_row")).select(key, "_row.*")


def read_unique(spark: SparkSession, out: str, key: str = "transaction_id") -> DataFrame:
    """The row of each key that arrived first."""
    return _first_of_each(parts.read_parts(spark, out), key)


# ----------------------------------------------------------------------------------------------- upserts
#
# A micro-batch must not rewrite a large ledger. It only adds its rows to the change folder; readers see the
# newest snapshot with the changes folded in, and a job that runs now and then writes that as a new snapshot.


def save_changes(path: str):
    """``foreachBatch`` function: a repeated batch overwrites its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    return save


def start_upsert(rows: DataFrame, initial: DataFrame, path: str, checkpoint: str, once: bool = True, interval: str = "10 minutes"):
    """Collect a stream of ledger rows next to the ledger; ``initial`` becomes the first snapshot."""
    if not parts.numbers(initial.sparkSession, f"{path}/ledger", "upto"):
        initial.write.mode("overwrite").parquet(f"{path}/ledger/upto=-1")
    return run_stream(rows.writeStream.foreachBatch(save_changes(path)), checkpoint, once, interval)


def current_ledger(spark: SparkSession, path: str, as_of, order: list[str]) -> DataFrame:
    """The newest snapshot with all later changes applied in batch order."""
    upto = parts.numbers(spark, f"{path}/ledger", "upto")[-1]
    snapshot = spark.read.parquet(f"{path}/ledger/upto={upto}")
    later = parts.numbers(spark, f"{path}/changes", "batch", upto)
    if not later:
        return snapshot
    folders = [f"{path}/changes/batch={n}" for n in later]
    changes = spark.read.option("basePath", f"{path}/changes").parquet(*folders)
    return ledger.upsert(snapshot, changes, as_of, ["batch", *order])


def compact(spark: SparkSession, path: str, as_of, order: list[str]) -> None:
    """Write the current ledger as a new snapshot. The folder read from is never the one written to; it and the changes
    after it stay for readers that have begun with it, what is older goes."""
    upto = parts.numbers(spark, f"{path}/ledger", "upto")[-1]
    later = parts.numbers(spark, f"{path}/changes", "batch", upto)
    if later:
        current_ledger(spark, path, as_of, order).write.mode("overwrite").parquet(f"{path}/ledger/upto={later[-1]}")
        parts.remove(spark, f"{path}/changes", "batch", upto)
        parts.remove(spark, f"{path}/ledger", "upto", upto - 1)


# ----------------------------------------------------------------------------------------------- metrics


def hourly_parts(predictions: DataFrame) -> DataFrame:
    """Counts and confidence sums per hour and model; parts of the same hour and model can be added."""
    at = F.col("created_at").cast("timestamp")
    return predictions.groupBy(F.date_trunc("hour", at).cast("timestamp_ntz").alias("hour"), "model_version").agg(
        F.count("*").alias("predictions"), F.count("prediction_confidence").alias("confidences"),
        F.sum("prediction_confidence").alias("confidence_sum"), F.max(at.cast("timestamp_ntz")).alias("newest"),
    )


def _added_hours(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("predictions", "confidences", "confidence_sum")]
    return rows.groupBy("hour", "model_version").agg(*sums, F.max("newest").alias("newest"))


def start_hourly_metrics(predictions: DataFrame, out: str, checkpoint: str, once: bool = True, interval: str = "10 minutes", every: int = 20):
    """Collect predictions, one folder per batch with its counts and sums per hour and model, folded at each ``every``-th
    batch. There is no watermark, so no prediction is too late. ``late.start_closed_hours`` writes each hour once, when it is closed."""
    return run_stream(predictions.writeStream.foreachBatch(parts.save_part(out, hourly_parts, _added_hours, every)), checkpoint, once, interval)


def read_hourly_metrics(spark: SparkSession, out: str, late: str = "1 hour") -> DataFrame:
    """Predictions and mean confidence per closed hour and model, of all batches so far. An hour is closed when the newest
    prediction is ``late`` past its end; predictions that come after that are still counted in it."""
    hours = parts.read_parts(spark, out)
    newest = hours.agg(F.max("newest") - F.expr(f"INTERVAL {late}"))
    closed = hours.where(F.col("hour") + F.expr("INTERVAL 1 HOUR") <= newest.scalar())
    return closed.groupBy("hour", "model_version").agg(
        F.sum("predictions").alias("predictions"), (F.sum("confidence_sum") / F.sum("confidences")).alias("avg_confidence")
    )


def category_counts_of(rows: DataFrame) -> Column:
    """The category that a row counts under."""
    known = [c for c in ("user_category", "predicted_category") if c in rows.columns]
    return F.coalesce(*known, F.lit(rules.UNCATEGORIZED))


def category_counts(rows: DataFrame) -> DataFrame:
    """Count and last use per user and category."""
    return rows.groupBy("user_id", category_counts_of(rows).alias("category")).agg(
        F.count("*").alias("transaction_count"), F.max("last_modified").alias("last_used")
    )


def _newest_of_each(rows: DataFrame) -> DataFrame:
    return latest_by(rows, ["user_id", "transaction_id"], ["last_modified", "batch"])


def start_category_counts(rows: DataFrame, out: str, checkpoint: str, once: bool = True, interval: str = "10 minutes", every: int = 20):
    """Collect the categories of transactions, one folder per batch with the newest row of each transaction in it, folded at
    each ``every``-th batch. ``late.start_running_counts`` keeps the categories as state and writes changes of counts only."""
    kept = [c for c in COUNTED if c in rows.columns]
    save = parts.save_part(out, lambda batch: latest_by(batch.select(*kept), ["user_id", "transaction_id"], ["last_modified"]), _newest_of_each, every)
    return run_stream(rows.writeStream.foreachBatch(save), checkpoint, once, interval)


def read_category_counts(spark: SparkSession, out: str) -> DataFrame:
    """Counts of the newest row of each transaction: one that was sent again counts once, one whose category was
    corrected counts under the new category only."""
    return category_counts(_newest_of_each(parts.read_parts(spark, out)))


def compact_category_rows(spark: SparkSession, out: str) -> None:
    """Fold all batches so far into a snapshot with the newest row of each transaction. It has a folder of its own, so a
    batch that is repeated afterwards replaces nothing of it."""
    parts.fold(spark, out, _newest_of_each)


def split_late(rows: DataFrame, at: str, floor) -> tuple[DataFrame, DataFrame]:
    """Rows on time and rows older than ``floor``; the late ones go to the batch path."""
    late = F.col(at) < floor
    return rows.filter(~F.coalesce(late, F.lit(False))), rows.filter(F.coalesce(late, F.lit(False)))
