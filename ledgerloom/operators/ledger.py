"""Upserts and patches of the ledger and the user table.

Without a table format that has MERGE, a new state is the full outer join of the old one and the batch on the row
key. ``upsert`` gives the whole of it; ``upsert_table`` keeps a table in partitions and replaces those that a batch touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.phonetic import codes
from ..session import reliable_checkpoint
from .rules import UNCATEGORIZED, document_key, is_writable

KEY = ["user_id", "transaction_id"]

# Fields a repeated ingest may overwrite; all others of an existing row are kept.
OVERWRITTEN = [
    "id_api", "amount", "vendor", "vendor_cleaned", "account", "template_used", "cleaned_metaphone", "date",
    "description", "account_id", "day", "day_name", "month", "year",
]
PREDICTION = ["predicted_category", "predicted_subcategory", "prediction_confidence", "model_version"]


def split_writable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the write gate, and the rest."""
    gated = rows.withColumn("_ok", is_writable(rows))
    return gated.filter("_ok").drop("_ok"), gated.filter("NOT _ok").drop("_ok")


def ledger_rows(rows: DataFrame, as_of) -> DataFrame:
    """Accepted rows in ledger layout: key, cleaned vendor, guarded date with parts, label defaults."""
    clock = dates.as_clock(as_of)
    date = F.col("date") if dict(rows.dtypes)["date"] == "timestamp_ntz" else dates.iso_to_utc(F.col("date"))
    rows = rows.withColumns(
        {
            "transaction_id": document_key(rows),
            "vendor_cleaned": text.clean_vendor(F.col("vendor")),
            "_date": date,
            "amount": F.col("amount").cast("double"),
        }
    )
    stated = dates.is_stated(F.col("_date"), clock)
    parts = {n: F.when(stated, c) for n, c in dates.date_parts(F.col("_date")).items()}
    labels = {
        n: F.coalesce(F.col(n), F.lit(UNCATEGORIZED)) if n in rows.columns else F.lit(UNCATEGORIZED)
        for n in ("predicted_category", "predicted_subcategory")
    }
    rows = rows.withColumns({**parts, **labels, "date": dates.guarded_date(F.col("_date"), clock)})
    rows = rows.withColumn("cleaned_metaphone", codes(F.col("vendor_cleaned")))
    return rows.drop("_date", "id")


def fold(changes: DataFrame, order: list[str]) -> DataFrame:
    """One row per key from several changes of it, as if applied one after the other: of overwritable fields the newest
    value that is not NULL, with the four prediction fields taken together, of all others the first row's value. Partial aggregates fold each task's rows before the shuffle."""
    groups = [[c] for c in changes.columns if c not in KEY + PREDICTION + order]
    together = [c for c in PREDICTION if c in changes.columns]
    if "predicted_category" in together:
        groups.append(together)
    else:
        groups += [[c] for c in together]
    newest = []
    for i, names in enumerate(groups):
        if names[0] not in OVERWRITTEN + PREDICTION:
            newest.append(F.min_by(F.struct(*names), F.struct(*order)).alias(f"_g{i}"))
            continue
        when = F.when(F.col(names[0]).isNotNull(), F.struct(*order))
        newest.append(F.max_by(F.struct(*names), when).alias(f"_g{i}"))
    kept = [F.max(F.struct(*order)).alias("_order")]
    folded = changes.groupBy(*KEY).agg(*kept, *newest)
    fields = {name: F.col(f"_g{i}.{name}") for i, names in enumerate(groups) for name in names}
    fields.update({name: F.col(f"_order.{name}") for name in order if name not in KEY})
    return folded.select(*KEY, *[fields[c].alias(c) for c in changes.columns if c not in KEY])


def upsert(ledger: DataFrame, batch: DataFrame, as_of, order: list[str] | None = None) -> DataFrame:
    """New snapshot. Known rows take the batch's non-NULL values of the overwritable fields and keep the
    rest; new rows are added whole. Doing it twice changes nothing.

    ``order`` names the columns that sort several batch rows of one key; the result is that of applying them
    one after the other."""
    clock = dates.as_clock(as_of)
    if order:
        batch = fold(batch, order)
    old, new = ledger.alias("old"), batch.alias("new")
    known = F.col("_old").isNotNull()
    arrived = F.col("_new").isNotNull()
    joined = old.withColumn("_old", F.lit(1)).join(new.withColumn("_new", F.lit(1)), KEY, "full_outer")
    out = []
    for name in ledger.columns:
        if name in KEY:
            out.append(F.col(name))
        elif name == "created_at":
            out.append(F.when(known, F.coalesce(F.col("old.created_at"), clock)).otherwise(clock).alias(name))
        elif name == "last_modified":
            out.append(F.when(arrived, clock).otherwise(F.col("old.last_modified")).alias(name))
        elif name == "status":
            out.append(F.when(arrived, F.lit("processed")).otherwise(F.col("old.status")).alias(name))
        elif name not in batch.columns:
            out.append(F.col(f"old.{name}"))
        elif name in PREDICTION:
            # a label, its confidence and its model belong together
            scored = F.col("new.predicted_category").isNotNull() if "predicted_category" in batch.columns else F.lit(False)
            out.append(F.when(scored, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name))
        elif name in OVERWRITTEN:
            out.append(F.coalesce(F.col(f"new.{name}"), F.col(f"old.{name}")).alias(name))
        else:
            out.append(F.when(known, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}")).alias(name))
    return joined.select(*out)


BUCKET = "ledger_bucket"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def create_table(ledger: DataFrame, path: str, buckets: int = 256) -> None:
    """The ledger as a table in partitions by a hash of the user; ``rebalance`` splits the files of a large one."""
    table = ledger.withColumn(BUCKET, _bucket(buckets)).hint("rebalance", BUCKET)
    table.write.mode("errorifexists").partitionBy(BUCKET).parquet(path)


def upsert_table(path: str, batch: DataFrame, as_of, order: list[str] | None = None, buckets: int = 256) -> None:
    """Merge a batch into the table of ``create_table``: only the partitions of the batch's users are read, joined and
    replaced. The new rows are written aside first, so that no folder is read while it is replaced. ``buckets`` is that of the table."""
    spark = batch.sparkSession
    touched = [r[0] for r in batch.select(_bucket(buckets)).distinct().collect()]  # numbers below ``buckets``
    table = spark.read.parquet(path)
    old = table.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    merged = reliable_checkpoint(upsert(old, batch, as_of, order).withColumn(BUCKET, _bucket(buckets)).hint("rebalance", BUCKET), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def patch(ledger: DataFrame, updates: DataFrame, as_of) -> DataFrame:
    """Overwrite the fields given in ``updates`` (one row per key) and stamp the row."""
    fields = [c for c in updates.columns if c not in KEY]
    joined = ledger.alias("old").join(updates.withColumn("_hit", F.lit(1)).alias("new"), KEY, "left")
    out = []
    for name in ledger.columns:
        if name in KEY:
            out.append(F.col(name))
        elif name == "last_modified":
            out.append(F.when(F.col("_hit").isNotNull(), dates.as_clock(as_of)).otherwise(F.col(f"old.{name}")).alias(name))
        elif name in fields:
            out.append(F.coalesce(F.col(f"new.{name}"), F.col(f"old.{name}")).alias(name))
        else:
            out.append(F.col(f"old.{name}"))
    return joined.select(*out)


def stamp_sync(users: DataFrame, synced: DataFrame, as_of) -> DataFrame:
    """Sync time and status of the users in ``synced``; others keep theirs."""
    hits = synced.select("user_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    return (
        users.join(hits, "user_id", "left")
        .withColumns(
            {
                "last_sync": F.when(hit, dates.as_clock(as_of)).otherwise(F.col("last_sync")),
                "last_sync_status": F.when(hit, F.lit("success")).otherwise(F.col("last_sync_status")),
            }
        )
        .drop("_hit")
    )


def retain_recent(df: DataFrame, column: str, days: int, as_of) -> DataFrame:
    """Rows not older than ``days``; feeds a partition overwrite."""
    return df.filter(F.col(column) >= dates.days_before(dates.as_clock(as_of), days))
