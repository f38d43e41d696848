"""Balancing, the exact time split, weights and the challenger share.

Both the balanced sample and the split need exact global ranks. Ranking in one window would sort a whole
category, or the whole table, in one task. Instead rows are counted in buckets of the sort key, the counts
are accumulated (a small table), and only the bucket in which the cut falls is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

SEED = 42
HASH_DIGITS = 3  # 4,096 buckets per category


def sample_key(row_id: Column, seed: int = SEED) -> Column:
    """Evenly spread, repeatable sort key of a row: a text hash that any engine can recompute."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f"-{seed}")))


def balance_categories(
    df: DataFrame, max_imbalance_ratio: float = 5.0, row_id: str = "transaction_id", seed: int = SEED
) -> DataFrame:
    """Cap each category at ``int(smallest * ratio)`` rows. Corrected rows are all kept, the others are
    sampled by hash up to the cap; with fewer than two categories nothing is dropped.

    The first pass counts rows per category and hash bucket. From these counts, a small table, follow the cap
    and the one bucket per category in which its cut falls. The second pass ranks the rows of those buckets
    only (1/4,096 of a category) to find the exact hash at the cut. The last pass compares each row with the
    cut of its category; the rows themselves are never shuffled as long as the cuts, one row per category,
    are small enough to be broadcast."""
    key = F.concat(sample_key(F.col(row_id), seed), F.lit(":"), F.col(row_id).cast("string"))
    fixed = F.coalesce("is_user_corrected", F.lit(False))
    keyed = df.select("category", fixed.alias("_fixed"), key.alias("_key")).withColumn(
        "_bucket", F.substring("_key", 1, HASH_DIGITS)
    )
    cells = reliable_checkpoint(
        keyed.groupBy("category", "_bucket").agg(F.count("*").alias("_all"), F.count_if(~F.col("_fixed")).alias("_open")),
        "cells",
    )
    sizes = cells.groupBy("category").agg(F.sum("_all").alias("_size"), F.sum(F.col("_all") - F.col("_open")).alias("_kept"))
    spread = sizes.agg(F.struct(F.min("_size").alias("least"), F.count("*").alias("n")).alias("s")).scalar()
    cap = F.floor(spread["least"] * F.lit(float(max_imbalance_ratio)))
    crowded = sizes.filter((spread["n"] > 1) & (F.col("_size") > cap)).select(
        "category", F.greatest(cap - F.col("_kept"), F.lit(0)).alias("_room")
    )
    upto = Window.partitionBy("category").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = cells.withColumn("_upto", F.sum("_open").over(upto)).join(crowded, "category")
    before = F.col("_upto") - F.col("_open")
    # whole buckets that fit; "g" sorts behind every hash digit
    full = running.groupBy("category").agg(
        F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_room"), F.concat("_bucket", F.lit("g")))), F.lit("")).alias("_full")
    )
    edges = running.filter((before < F.col("_room")) & (F.col("_upto") > F.col("_room"))).select(
        "category", "_bucket", (F.col("_room") - before).alias("_take")
    )
    rank = F.row_number().over(Window.partitionBy("category", "_bucket").orderBy("_key"))
    edge_cut = keyed.filter("NOT _fixed").join(edges, ["category", "_bucket"]).withColumn("_rank", rank).filter(
        F.col("_rank") == F.col("_take")
    ).select("category", F.col("_key").alias("_edge"))
    cuts = reliable_checkpoint(
        full.join(edge_cut, "category", "left").select("category", F.coalesce("_edge", "_full").alias("_cut")), "cuts"
    )
    kept = fixed | F.col("_cut").isNull() | (key <= F.col("_cut"))
    return df.join(cuts, "category", "left").filter(kept).select(*df.columns)


SKETCH = 10_000  # accuracy of the sketch that brackets the cut
CELLS = 1 << 16  # intervals into which a bracket is divided
EDGE = 100_000  # rows that are ranked one by one
_NONE = -(1 << 63)  # stands for a missing date, which comes first


def _micros(date: str) -> Column:
    return F.coalesce(F.unix_micros(F.col(date).cast("timestamp")), F.lit(_NONE))


def bracket(df: DataFrame, share: float, date: str) -> tuple[int, int, int]:
    """Number of rows, and two instants between which the row at ``share`` of them should be: one scan, a quantile sketch."""
    around = [max(share - 2 / SKETCH, 0.0), min(share + 2 / SKETCH, 1.0)]
    found = df.agg(F.count("*").alias("n"), F.percentile_approx(_micros(date), around, SKETCH).alias("q")).first()
    return (found["n"], *(found["q"] or (0, 0)))


def time_cut(df: DataFrame, target: int, low: int, high: int, date: str, cell: Column):
    """Where row number ``target`` (from 0) falls in the order (date, hash cell), missing dates first: an interval of
    instants ``[low, high)``, its hash cell or None for all, and the number of rows ahead. None when there is no such row.

    One pass counts the rows before the bracket and in each of CELLS intervals of it, which settles the cut unless more than
    EDGE rows are in its interval. Then that interval is divided in turn, and a single instant by hash cells. A bracket
    that does not hold the row is widened, so a sketch may be wrong. Counts of at most CELLS + 2 keys are
    accumulated, and one row a pass comes back to the driver."""
    at = _micros(date)
    high += 1
    while True:
        if low == _NONE:  # the bracket starts among missing dates: these, and all instants in it
            key = F.when(at == _NONE, -1).when(at < high, 0).otherwise(CELLS)
        else:
            width = max(1, -(-(high - low) // CELLS))
            key = F.when(at < low, -1).when(at >= high, CELLS).otherwise(F.floor((at - F.lit(low)) / F.lit(width)).cast("bigint"))
        counts = df.groupBy(key.cast("bigint").alias("key")).agg(F.count("*").alias("n"), F.min(at).alias("least"), F.max(at).alias("most"))
        upto = F.sum("n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("upto", upto).filter(F.col("upto") > target).orderBy("upto").limit(1).first()
        if hit is None:
            return None
        low, high = hit["least"], hit["most"] + 1
        if hit["n"] <= EDGE:
            return low, high, None, hit["upto"] - hit["n"]
        if high == low + 1:
            break
    ahead = hit["upto"] - hit["n"]
    cells = df.filter(at == low).groupBy(cell.alias("key")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.asc_nulls_first("key")).rowsBetween(Window.unboundedPreceding, 0))
    hit = cells.withColumn("upto", upto).filter(F.col("upto") > target - ahead).orderBy("upto").limit(1).first()
    return low, high, hit["key"], ahead + hit["upto"] - hit["n"]


def split_by_time(
    df: DataFrame, train_share: float = 0.8, date: str = "date", row_id: str = "transaction_id", seed: int = SEED
) -> DataFrame:
    """Append ``is_train``: true for the first ``int(n * share)`` rows by (date, hash of the id), missing dates first.

    Two scans find the cut, a quantile sketch and one pass of counts; only where very many rows share an interval or an
    instant are there more. Rows before and after the cut are told apart by comparing with constants; only the at most
    EDGE rows around it, or 1/65,536 of those that share one timestamp, are ranked. ``df`` is read several times: pass
    a table, not a costly plan."""
    key = sample_key(F.col(row_id), seed)
    cell = F.substring(key, 1, 4)
    n, low, high = bracket(df, train_share, date)
    target = int(n * train_share)
    cut = time_cut(df, target, low, high, date, cell)
    if cut is None:
        return df.withColumn("is_train", F.lit(True))
    low, high, cut_cell, ahead = cut
    at = F.col(date)
    if low == _NONE:
        inside, before = at.isNull(), F.lit(False)
    else:  # constants of the column's own type, so that the range reaches the scan
        first, last = (F.timestamp_micros(F.lit(m)).cast(df.schema[date].dataType) for m in (low, high - 1))
        inside, before = F.coalesce(at.between(first, last), F.lit(False)), at.isNull() | (at < first)
    on_edge = inside if cut_cell is None else inside & (cell == cut_cell)
    if cut_cell is not None:
        before = before | (inside & (cell < cut_cell))
    rank = F.row_number().over(Window.partitionBy("_edge").orderBy(F.asc_nulls_first(date), "_key", row_id))
    edge = df.filter(on_edge).withColumns({"_key": key, "_edge": F.lit(0)}).withColumn("is_train", rank + F.lit(ahead) <= target)
    rest = df.filter(~on_edge).withColumn("is_train", before)
    return rest.unionByName(edge.select(*df.columns, "is_train"))


def with_weights(df: DataFrame, corrected_weight: float = 3.0) -> DataFrame:
    return df.withColumn(
        "sample_weight", F.when(F.coalesce("is_user_corrected", F.lit(False)), corrected_weight).otherwise(1.0)
    )


def assign_challenger(df: DataFrame, percent: int = 20, row_id: str = "transaction_id", seed: int = SEED) -> DataFrame:
    """Mark a repeatable share of the rows for the challenger model."""
    bucket = F.conv(F.substring(sample_key(F.col(row_id), seed), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("is_challenger", bucket < percent)
