"""Scans. Each returns a lazy DataFrame; filters are column expressions so that they reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, text
from ..functions.phonetic import primary_code
from ..operators.common import drop_label_columns, top_k_per_group

# JSON text columns of the warehouse table.
JSON_COLUMNS = ["metadata", "ml_features", "user_feedback"]


# ---------------------------------------------------------------------------------------------- messages


def read_messages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.struct(schemas.MESSAGE_DDL)).format(fmt).load(path)


def unread_messages(messages: DataFrame, label: str = "UNREAD", folder: str | None = None) -> DataFrame:
    """Messages that carry the unread label, and the folder label when one is given."""
    out = messages.filter(F.array_contains("labelIds", label))
    return out.filter(F.array_contains("labelIds", folder)) if folder else out


def search_messages(messages: DataFrame, start: str, end: str, folder: str | None = None) -> DataFrame:
    """Messages about transactions by subject and sender, sent on or after ``start`` and before ``end``.

    ``messages`` has ``subject``, ``from_addr`` and ``sent_at``."""
    subject, sender = F.lower("subject"), F.lower("from_addr")
    # The search terms.
    wanted = (
        subject.contains("transaction")
        | subject.contains("external transfer")
        | subject.contains("payment through chase")
        | (sender.contains("huntington") & subject.contains("withdrawal or purchase"))
        | (sender.contains("huntington") & subject.contains("deposit") & ~subject.contains("early pay"))
        | (subject.contains("account ending in") & ~sender.contains("noreply.pncalerts@pnc.com"))
    )
    begin, stop = (F.lit(d).cast("date").cast("timestamp_ntz") for d in (start, end))
    out = messages.filter((F.col("sent_at") >= begin) & (F.col("sent_at") < stop) & ~subject.contains("statement") & wanted)
    return out.filter(F.array_contains("labelIds", folder)) if folder else out


# ---------------------------------------------------------------------------------------- ledger and more


def scan_ledger(
    ledger: DataFrame,
    user_ids: list[str] | None = None,
    start=None,
    end=None,
    limit_per_user: int | None = None,
) -> DataFrame:
    """Ledger by users and date range. The limit counts per user, oldest rows first."""
    out = ledger
    if isinstance(user_ids, DataFrame):  # a list of any length
        out = out.join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
    elif user_ids:
        out = out.filter(F.col("user_id").isin(list(user_ids)))
    if start is not None:
        out = out.filter(F.col("date") >= dates.as_clock(start))
    if end is not None:
        out = out.filter(F.col("date") <= dates.as_clock(end))
    if limit_per_user:
        out = top_k_per_group(
            out, ["user_id"], [F.col("date"), F.col("transaction_id")], limit_per_user, F.col("transaction_id")
        )
    return drop_label_columns(out)


def scan_warehouse(table: DataFrame, user_id=None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Warehouse rows with optional predicates, old label columns dropped, JSON texts parsed."""
    out = table
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    if start is not None:
        out = out.filter(F.col("date") >= dates.as_clock(start))
    if end is not None:
        out = out.filter(F.col("date") <= dates.as_clock(end))
    if limit:
        out = out.orderBy("date", "transaction_id").limit(limit)
    return parse_json_columns(drop_label_columns(out))


def parse_json_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """JSON texts to VARIANT; junk becomes NULL. Read fields with ``try_variant_get``."""
    names = [c for c in (names or JSON_COLUMNS) if c in df.columns and dict(df.dtypes)[c] == "string"]
    return df.withColumns({c: F.try_parse_json(F.col(c)) for c in names})


def read_training_parts(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet parts of a folder, columns merged by name; an empty set is refused."""
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "false").parquet(path)
    if df.isEmpty():
        raise ValueError("No training data found")
    return df


TRAINING_CSV_DDL = (
    "transaction_id STRING, user_id STRING, vendor STRING, amount DOUBLE, account STRING, template_used STRING, "
    "date TIMESTAMP_NTZ, category STRING, subcategory STRING, is_user_corrected BOOLEAN"
)


def read_training_csv(spark: SparkSession, path: str, ddl: str = TRAINING_CSV_DDL) -> DataFrame:
    """CSV training rows with features derived again and blanks filled with ``unknown``."""
    return derive_training_texts(spark.read.schema(ddl).option("header", "true").csv(path))


def derive_training_texts(df: DataFrame) -> DataFrame:
    unknown = lambda c: F.coalesce(text.blank_to_null(c), F.lit("unknown"))
    df = df.withColumn("vendor_cleaned", text.clean_vendor(F.col("vendor"), "unknown"))
    code = F.when(F.col("vendor_cleaned") != "unknown", primary_code(F.col("vendor_cleaned")))
    df = df.withColumn("cleaned_metaphone", unknown(code))
    filled = {c: unknown(F.col(c)) for c in ("vendor", "template_used", "account") if c in df.columns}
    return df.withColumns({**filled, **dates.date_parts(F.col("date"))})


def get_transaction(ledger: DataFrame, transaction_id: str, user_id: str) -> DataFrame:
    return ledger.filter((F.col("user_id") == user_id) & (F.col("transaction_id") == transaction_id))


def sample_per_template(ledger: DataFrame) -> DataFrame:
    """One transaction per template, the lowest (user, id)."""
    named = ledger.filter(F.col("template_used") > "")
    rest = [c for c in ledger.columns if c != "template_used"]
    row = F.min_by(F.struct(*rest), F.struct("user_id", "transaction_id")).alias("row")
    return named.groupBy("template_used").agg(row).select("template_used", "row.*")
