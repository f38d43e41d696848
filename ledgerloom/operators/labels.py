"""Training export, feedback joins and user corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from .common import latest_by
from .rules import UNCATEGORIZED, corrected_by_export, enabled_users, resolve_label


def day_range(start: str, end: str, column: str = "date"):
    """Condition on whole days, both ends included, that the Parquet scan can use."""
    begin = F.lit(start).cast("date").cast("timestamp_ntz")
    stop = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return (F.col(column) >= begin) & (F.col(column) < stop)


def enabled_ledger(ledger: DataFrame, users: DataFrame) -> DataFrame:
    """Ledger rows of users with sync switched on (semi join, users are never widened into the rows)."""
    enabled = users.filter(F.coalesce("email_sync_enabled", F.lit(False))).select("user_id")
    return ledger.join(enabled, "user_id", "left_semi")


def synced_ledger(ledger: DataFrame, users: DataFrame) -> DataFrame:
    """As ``enabled_ledger`` but only users that also have an address."""
    return ledger.join(enabled_users(users).select("user_id"), "user_id", "left_semi")


def export_rows(ledger: DataFrame, users: DataFrame, start, end) -> DataFrame:
    """Ledger to warehouse layout: enabled users, date range, labels resolved, corrected flag."""
    in_range = ledger.filter(F.col("date").between(dates.as_clock(start), dates.as_clock(end)))
    rows = enabled_ledger(in_range, users)
    copied = [
        "transaction_id", "user_id", "vendor", "vendor_cleaned", "cleaned_metaphone", "account", "template_used",
        "date", "day", "month", "year", "day_name", "prediction_confidence", "model_version", "created_at",
    ]
    return rows.select(
        *[c for c in copied if c in rows.columns],
        F.coalesce("amount", F.lit(0.0)).cast("double").alias("amount"),
        resolve_label(F.col("user_category"), F.col("predicted_category")).alias("category"),
        resolve_label(F.col("user_subcategory"), F.col("predicted_subcategory")).alias("subcategory"),
        corrected_by_export(rows).alias("is_user_corrected"),
        *([F.col("last_modified").alias("updated_at")] if "last_modified" in rows.columns else []),
    )


def with_feedback(
    training: DataFrame,
    feedback: DataFrame,
    start: str,
    end: str,
    only_categorized: bool = True,
    feedback_until: str | None = None,
    mode: str = "all",
    ordered: bool = True,
) -> DataFrame:
    """Training rows with the user's labels on top (left join on transaction and user).

    ``mode='all'`` gives one row per feedback entry, ``'latest'`` only the newest entry per transaction. The
    join is an ordinary shuffle join on (transaction, user); a hot key is split by adaptive execution."""
    entries = feedback
    if feedback_until is not None:
        stop = F.date_add(F.lit(feedback_until).cast("date"), 1).cast("timestamp_ntz")
        entries = entries.filter(F.col("feedback_timestamp") < stop)
    entries = entries.select(
        "transaction_id",
        "user_id",
        "feedback_id",
        "feedback_timestamp",
        F.col("user_category").alias("_category"),
        (F.col("user_subcategory") if "user_subcategory" in feedback.columns else F.lit(None).cast("string")).alias(
            "_subcategory"
        ),
    )
    if mode == "latest":
        entries = latest_by(entries, ["transaction_id", "user_id"], ["feedback_timestamp", "feedback_id"])
    joined = training.filter(day_range(start, end)).join(entries, ["transaction_id", "user_id"], "left")
    category = F.coalesce("_category", "category")
    if only_categorized:
        joined = joined.filter(category != UNCATEGORIZED)
    kept = ["vendor", "vendor_cleaned", "cleaned_metaphone", "amount", "account", "template_used"]
    out = joined.select(
        "transaction_id",
        "user_id",
        *[c for c in kept if c in training.columns],
        *[c.alias(n) for n, c in dates.date_parts(F.col("date")).items()],
        category.alias("category"),
        F.coalesce("_subcategory", "subcategory").alias("subcategory"),
        F.col("feedback_id").isNotNull().alias("is_user_corrected"),
        *(["model_version"] if "model_version" in training.columns else []),
        "date",
    )
    if ordered:
        # the id as last key lets the range sort split a day that holds a large share of the rows
        out = out.orderBy(F.col("is_user_corrected").desc(), F.col("date").desc(), F.col("transaction_id"))
    return out


def label_sources(df: DataFrame) -> DataFrame:
    """How many rows get their label from the user, from the prediction, or from nowhere."""
    user = F.col("user_category").isNotNull()
    predicted = ~user & F.nullif(F.col("predicted_category"), F.lit(UNCATEGORIZED)).isNotNull()
    return df.agg(
        F.count_if(user).alias("from_user"),
        F.count_if(predicted).alias("from_prediction"),
        F.count_if(~user & ~predicted).alias("uncategorized"),
    )


# ------------------------------------------------------------------------------------------- corrections


def apply_corrections(ledger: DataFrame, corrections: DataFrame, as_of) -> DataFrame:
    """User labels onto the ledger: newest correction per row, NULLs do not clear, the vendor override stays
    when none is given, and the row is marked as corrected."""
    clock = dates.as_clock(as_of)
    newest = latest_by(
        corrections.select("transaction_id", "user_id", "new_category", "new_subcategory", "new_vendor", "corrected_at"),
        ["transaction_id", "user_id"],
        ["corrected_at", "new_category"],
    )
    hit = F.col("new_category").isNotNull()
    joined = ledger.join(newest, ["transaction_id", "user_id"], "left")
    changed = {
        "user_category": F.coalesce("new_category", "user_category"),
        "user_subcategory": F.coalesce("new_subcategory", "user_subcategory"),
        "user_vendor": F.coalesce("new_vendor", "user_vendor"),
        "user_corrected": F.when(hit, F.lit(True)).otherwise(F.col("user_corrected")),
        "feedback_timestamp": F.when(hit, F.col("corrected_at")).otherwise(
            F.col("feedback_timestamp") if "feedback_timestamp" in ledger.columns else F.lit(None).cast("timestamp_ntz")
        ),
        "last_modified": F.when(hit, clock).otherwise(F.col("last_modified")),
    }
    names = ledger.columns + [c for c in changed if c not in ledger.columns]
    return joined.withColumns(changed).select(*names)


def mark_feedback(ledger: DataFrame, feedback: DataFrame) -> DataFrame:
    """Set the corrected flag and the newest feedback time on rows that have feedback."""
    newest = feedback.groupBy("transaction_id", "user_id").agg(F.max("feedback_timestamp").alias("_at"))
    joined = ledger.join(newest, ["transaction_id", "user_id"], "left")
    hit = F.col("_at").isNotNull()
    return joined.withColumns(
        {
            "user_corrected": F.when(hit, F.lit(True)).otherwise(F.col("user_corrected")),
            "feedback_timestamp": F.coalesce(
                F.col("_at"),
                F.col("feedback_timestamp") if "feedback_timestamp" in ledger.columns else F.lit(None).cast("timestamp_ntz"),
            ),
        }
    ).drop("_at")


def feedback_rows(ledger: DataFrame, corrections: DataFrame, include_confirmations: bool = False) -> DataFrame:
    """Feedback entries for corrections of scored rows. By default only changed labels are recorded; with
    ``include_confirmations`` agreeing ones are too, which makes measured accuracy meaningful."""
    joined = corrections.join(ledger, ["transaction_id", "user_id"], "inner")
    original = F.coalesce(F.col("old_category"), F.col("predicted_category")) if "old_category" in corrections.columns \
        else F.col("predicted_category")
    scored = joined.withColumn("original_category", original).filter(F.col("model_version").isNotNull())
    if not include_confirmations:
        scored = scored.filter(~F.col("original_category").eqNullSafe(F.col("new_category")))
    optional = {"vendor": "string", "vendor_cleaned": "string", "template_used": "string"}
    return scored.select(
        F.concat_ws("_", "transaction_id", F.unix_micros(F.col("corrected_at").cast("timestamp")).cast("string")).alias(
            "feedback_id"
        ),
        "transaction_id",
        "user_id",
        "original_category",
        F.col("predicted_subcategory").alias("original_subcategory"),
        F.col("new_category").alias("user_category"),
        F.col("new_subcategory").alias("user_subcategory"),
        "prediction_confidence",
        "model_version",
        *[(F.col(c) if c in ledger.columns else F.lit(None).cast(t)).alias(c) for c, t in optional.items()],
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        F.col("corrected_at").alias("feedback_timestamp"),
        F.col("date").alias("transaction_date"),
    )


def newest_export(training: DataFrame) -> DataFrame:
    """Exports overlap; keep the newest copy of each transaction."""
    order = [c for c in ("updated_at", "created_at", "date") if c in training.columns]
    return latest_by(training, ["transaction_id", "user_id"], order)


