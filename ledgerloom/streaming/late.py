"""Streams that keep bounded state behind an event-time watermark, and the batch path for rows that come too late.

``start_router`` marks each row by the stream's own watermark and writes it exactly once. The jobs on the rows in time read
its batches whole and in order, and late rows do not move a watermark; so theirs is never ahead of the router's, none of
their rows is dropped, and every row is counted either by them or by the batch jobs on the late rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import rules
from . import parts
from .jobs import category_counts_of, hourly_parts, run_stream

GROUPS = 200  # of rows that are marked together


def _millis(at: Column) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / 1000)


def mark_late(rows: DataFrame, at: str, delay: str, until: Column | None = None) -> DataFrame:
    """A stream's rows with ``late``: whether the watermark, the newest ``at`` of the batches before less ``delay``, has
    reached ``until`` (default: ``at``). Rows without a time are late. The watermark is Spark's own, which is in the
    offset log, so a repeated batch marks its rows as before. No state is stored."""
    columns = rows.columns
    timed = rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay).withColumn("_group", F.pmod(F.xxhash64(*columns), F.lit(GROUPS)))

    def mark(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reached = state.getCurrentWatermarkMs()
        for frame in frames:
            yield frame[columns].assign(_reached=reached)

    schema = T.StructType([*rows.schema.fields, T.StructField("_reached", T.LongType())])
    marked = timed.groupBy("_group").applyInPandasWithState(mark, schema, "seen BOOLEAN", "append", GroupStateTimeout.NoTimeout)
    end = _millis(F.col(at) if until is None else until)
    return marked.select(*columns, F.coalesce(end <= F.col("_reached"), F.lit(True)).alias("late"))


def start_router(rows: DataFrame, at: str, delay: str, out: str, checkpoint: str, until: Column | None = None, once: bool = True, interval: str = "10 minutes"):
    """Write a stream's rows to ``out`` in ``late=false`` and ``late=true``. The file sink's log makes each batch's rows
    visible at once and only once, to batch readers and to streams."""
    marked = mark_late(rows, at, delay, until)
    return run_stream(marked.writeStream.format("parquet").partitionBy("late").option("path", out).outputMode("append"), checkpoint, once, interval)


def _routed_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])


def read_routed(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The router's rows so far, with ``late``; a filter on that reads one of the two folders."""
    return spark.read.schema(_routed_schema(schema)).parquet(out)


def in_time(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The router's rows in time, as a stream. Without a limit on files a batch of the router, whose files are not in the
    order of time, is never divided."""
    return spark.readStream.schema(_routed_schema(schema)).parquet(out).where("NOT late").drop("late")


def late_rows(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The router's late rows so far."""
    return read_routed(spark, out, schema).where("late").drop("late")


# ----------------------------------------------------------------------------------------------- duplicates


def _day(at: str) -> Column:
    return F.coalesce(F.to_date(at), F.lit("1970-01-01").cast("date")).alias("at_day")


def start_unique_within(rows: DataFrame, at: str, delay: str, out: str, checkpoint: str, key: str = "transaction_id", once: bool = True, interval: str = "10 minutes"):
    """One row per key of a stream of rows in time; copies of a row have its time. State is kept for ``delay`` of event time."""
    timed = rows.select("*", _day(at)).withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    unique = timed.dropDuplicatesWithinWatermark([key]).drop("_at")
    return run_stream(unique.writeStream.format("parquet").partitionBy("at_day").option("path", out).outputMode("append"), checkpoint, once, interval)


def late_unique(table: DataFrame, late: DataFrame, at: str, key: str = "transaction_id") -> DataFrame:
    """One late row per key that the table lacks. Copies have the same time, so only the late rows' days of the table are read."""
    days = [r[0] for r in late.select(_day(at)).distinct().collect()]  # of the calendar
    known = table.where(F.col("at_day").isin(days)).select("at_day", key)
    return late.select("*", _day(at)).dropDuplicates([key]).join(known, ["at_day", key], "left_anti")


def read_unique_within(spark: SparkSession, out: str, routed: str, schema: T.StructType, at: str, key: str = "transaction_id") -> DataFrame:
    """The rows in time and the late ones that the stream had not seen."""
    table = spark.read.schema(T.StructType([*schema.fields, T.StructField("at_day", T.DateType())])).parquet(out)
    return table.unionByName(late_unique(table, late_rows(spark, routed, schema), at, key)).drop("at_day")


# ----------------------------------------------------------------------------------------------- closed hours


def hour_end(at: str) -> Column:
    return F.date_trunc("hour", F.col(at).cast("timestamp")) + F.expr("INTERVAL 1 HOUR")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hour", "model_version").agg(*[F.sum(c).alias(c) for c in ("predictions", "confidences", "confidence_sum")])


def start_closed_hours(predictions: DataFrame, delay: str, out: str, checkpoint: str, every: int = 20, once: bool = True, interval: str = "10 minutes"):
    """Counts and sums per hour and model from a stream of predictions in time, written when the watermark has passed the
    hour. State is kept for open hours only; the written parts are folded at each ``every``-th batch."""
    timed = predictions.withColumn("_at", F.col("created_at").cast("timestamp")).withWatermark("_at", delay)
    hours = timed.groupBy(F.window("_at", "1 hour"), "model_version").agg(
        F.count("*").alias("predictions"), F.count("prediction_confidence").alias("confidences"), F.sum("prediction_confidence").alias("confidence_sum")
    )
    closed = hours.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "model_version", "predictions", "confidences", "confidence_sum")
    save = parts.save_part(out, lambda batch: batch, _sums, every)
    return run_stream(closed.writeStream.outputMode("append").foreachBatch(save), checkpoint, once, interval)


def fold_late_hours(late: DataFrame, out: str) -> None:
    """The batch job on late predictions: their counts and sums, next to those of the stream. Hours of late rows are closed."""
    hourly_parts(late.where("created_at IS NOT NULL")).drop("newest").write.mode("overwrite").parquet(f"{out}/late")


def read_closed_hours(spark: SparkSession, out: str) -> DataFrame:
    """Predictions and mean confidence per closed hour and model, late rows included."""
    both = parts.read_parts(spark, out).drop("batch").unionByName(spark.read.parquet(f"{out}/late"))
    return _sums(both).select("hour", "model_version", "predictions", (F.col("confidence_sum") / F.nullif("confidences", F.lit(0))).alias("avg_confidence"))


# ----------------------------------------------------------------------------------------------- running counts

STATE_GROUPS = 1 << 16  # sets of transactions whose state is kept together
NEVER = -(1 << 53)  # stands for a missing time; whole numbers above it are exact in pandas


def _pack(held: dict) -> bytes:
    return pickle.dumps(held, pickle.HIGHEST_PROTOCOL)


def category_changes(rows: DataFrame, groups: int = STATE_GROUPS) -> DataFrame:
    """``user_id, category, change, at`` for each transaction whose newest row changed: one less under the category it had,
    one more under the one it has. The state is the category and time of each transaction. A row that was sent again
    changes nothing, an older one neither; of rows of one time the last category in code point order counts.

    A call of the Python function costs far more than a row, so transactions are kept together by a hash in ``groups`` sets
    at most; a batch writes the state of those sets only that it has rows of. ``groups`` stays as it is for a checkpoint."""
    at = F.coalesce(F.unix_micros(F.col("last_modified").cast("timestamp")), F.lit(NEVER))
    group = F.pmod(F.xxhash64("user_id", "transaction_id"), F.lit(groups)).alias("_group")
    named = rows.select("user_id", "transaction_id", category_counts_of(rows).alias("category"), at.alias("at"), group)

    def move(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        before, names = {}, {}  # of the transactions that changed; one object for each category
        for frame in frames:
            for user, transaction, category, when in zip(frame["user_id"], frame["transaction_id"], frame["category"], frame["at"].tolist()):
                which, row = (user, transaction), (when, names.setdefault(category, category))
                old = held.get(which)
                if old is None or row > old:
                    before.setdefault(which, old)
                    held[which] = row
        if not before:
            return
        state.update((_pack(held),))
        changes = []
        for which, old in before.items():
            when, category = held[which]
            if old is not None and old[1] != category:
                changes.append((which[0], old[1], -1, NEVER))
            changes.append((which[0], category, 0 if old is not None and old[1] == category else 1, when))
        yield pd.DataFrame(changes, columns=["user_id", "category", "change", "at"])

    return named.groupBy("_group").applyInPandasWithState(
        move, "user_id STRING, category STRING, change BIGINT, at BIGINT", "held BINARY", "update", GroupStateTimeout.NoTimeout
    )


def _totals(changes: DataFrame) -> DataFrame:
    return changes.groupBy("user_id", "category").agg(F.sum("change").alias("change"), F.max("at").alias("at"))


def start_running_counts(rows: DataFrame, out: str, checkpoint: str, every: int = 20, once: bool = True, interval: str = "10 minutes"):
    """Add the changes of each batch to ``out``, one row per user and category, folded at each ``every``-th batch."""
    save = parts.save_part(out, _totals, lambda all_parts: _totals(all_parts).where("change <> 0"), every)
    return run_stream(category_changes(rows).writeStream.outputMode("update").foreachBatch(save), checkpoint, once, interval)


def read_running_counts(spark: SparkSession, out: str) -> DataFrame:
    """Count and last use per user and category."""
    totals = _totals(parts.read_parts(spark, out)).where("change > 0")
    used = F.when(F.col("at") > NEVER, F.timestamp_micros("at").cast("timestamp_ntz"))
    return totals.select("user_id", F.coalesce("category", F.lit(rules.UNCATEGORIZED)).alias("category"), F.col("change").alias("transaction_count"), used.alias("last_used"))
