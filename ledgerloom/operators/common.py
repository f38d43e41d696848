"""Small building blocks used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest in ``order``.

    An aggregate, not a window: partial ``max_by`` shrinks every task's rows to one per key before the
    shuffle, so a key that holds a large share of the table costs no single task its whole history.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_k_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, spread: Column, salts: int = 64
) -> DataFrame:
    """First ``k`` rows per key. For small ``k`` Spark cuts each task to ``k`` rows per key before the
    shuffle; for a larger one a first pass over salted keys does the same, so no task sorts a whole hot key."""
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
        first = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
        df = df.withColumn("_rank", first).filter(F.col("_rank") <= k).drop("_rank", "_salt")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


ROWS_PER_TASK = 20_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in tasks of about ROWS_PER_TASK, and one a core at least, for steps that cost far more than their rows' bytes tell:
    a file of a few megabytes, or a shuffle that adaptive execution made few tasks of, holds a million small rows.
    With ``keys``, equal keys share a task."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    return df.repartition(tasks, *keys)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Row numbers from 1 of a sorted table, in its order. No task sees more than its own rows: each numbers those it has, and
    the rows of the tasks before are added. The table is written once, because sorting it again could cut it elsewhere."""
    own = 33  # bits of the number inside a task
    rows = reliable_checkpoint(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", own)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    placed = rows.withColumn("_part", part).join(starts, "_part")
    return placed.select(*df.columns, (F.col("_start") + F.col("_at").bitwiseAND((1 << own) - 1) + 1).alias(name))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Raise when columns are missing; a check of the schema, no job runs."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def drop_label_columns(df: DataFrame) -> DataFrame:
    """Old ``category`` and ``subcategory`` columns are replaced by the user and predicted ones."""
    return df.drop("category", "subcategory")
