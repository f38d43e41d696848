"""Jobs made of the operators: extract and load, export, prepare, train, correct, monitor, report."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import extraction, labels, ledger, model, reports, rules, sampling
from ..operators.common import spread
from ..operators.ledger_table import LedgerTable
from ..session import reliable_checkpoint
from ..sources import readers, writers

# Days covered by a full and by an incremental export, and days files are kept.
FULL_EXPORT_DAYS, INCREMENTAL_EXPORT_DAYS, KEEP_DAYS = 180, 7, 30
# Fixed value: start of the account id of a mailbox.
ACCOUNT_PREFIX = "gmail_"


@dataclass
class Loaded:
    ledger: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    outcomes: DataFrame
    summary: DataFrame | None = None
    users: DataFrame | None = None


def stage_transactions(parsed: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Parsed messages to validated ledger input with ``errors``."""
    account_id = F.concat(F.lit(ACCOUNT_PREFIX), F.col("user_id"))
    if users is not None:
        email = rules.enabled_users(users).select("user_id", F.col("contactInformation._email").alias("_email"))
        parsed = parsed.join(email, "user_id")  # others are not synchronised
        account_id = F.concat(F.lit(ACCOUNT_PREFIX), "_email")
    rows = parsed.select(
        F.col("message_id").alias("id"),
        F.col("id").alias("id_api"),
        "user_id",
        account_id.alias("account_id"),
        "account",
        "template_used",
        "date",
        "amount",
        F.coalesce("vendor", F.lit("Unknown transaction")).alias("vendor"),
        F.coalesce("vendor", F.lit("Unknown transaction")).alias("description"),
        F.lit(rules.UNCATEGORIZED).alias("predicted_category"),
        F.lit(None).cast("string").alias("predicted_subcategory"),
        F.lit(0.0).alias("prediction_confidence"),
        F.lit(None).cast("string").alias("model_version"),
        "parse_status",
    )
    iso = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")
    checked = rules.validation_errors(rows.withColumn("date", iso))
    checked_rows = rows.withColumns({"_date": F.col("date"), "date": iso}).withColumn("errors", checked)
    return checked_rows.withColumn("date", F.col("_date")).drop("_date")  # with its fraction of a second


def parse_table(messages: DataFrame, as_of, users: DataFrame | None = None, scorer=None, templates=None) -> DataFrame:
    """Unread messages parsed, scored and validated, as one written table that the later steps read. Parsing
    is the costly step and runs once, and a lost executor costs a re-read, not a second parse.

    ``result`` is ``ok``, or the reason why the row goes to quarantine."""
    parsed = extraction.parse_messages(readers.unread_messages(messages), as_of, templates)
    staged = stage_transactions(parsed, users)
    if scorer is not None:
        staged = rules.apply_prediction(scorer(staged))
    result = (
        F.when(F.col("parse_status") != "ok", F.col("parse_status"))
        .when(F.size("errors") > 0, F.concat(F.lit("invalid: "), F.array_join("errors", "; ")))
        .when(~rules.is_writable(staged), "invalid: missing required fields")
        .otherwise("ok")
    )
    return reliable_checkpoint(staged.withColumn("result", result).drop("errors"), "parsed")


def _stored(target: DataFrame | LedgerTable, accepted: DataFrame, as_of, order: list[str]) -> DataFrame:
    """The ledger with the accepted rows: merged into its table, or as a new state of a DataFrame."""
    if isinstance(target, LedgerTable):
        target.merge(accepted, as_of, order)
        return target.read()
    return ledger.upsert(target, accepted, as_of, order=order)


def extract_and_load(
    messages: DataFrame, ledger_table: DataFrame | LedgerTable, as_of, users: DataFrame | None = None, scorer=None
) -> Loaded:
    """Unread messages into the ledger: parse, score, validate, clean, upsert, and count per user. With ``users``, only
    those with sync on and an address are processed, and each gets a summary and a sync stamp. A ``LedgerTable`` is
    changed in place; of a DataFrame the new state is returned."""
    table = parse_table(messages, as_of, users, scorer)
    good = table.filter(F.col("result") == "ok").drop("result", "parse_status")
    accepted = ledger.ledger_rows(good, as_of)
    rejected = table.filter(F.col("result") != "ok").select(
        F.coalesce("id", "id_api").alias("message_id"), "user_id", F.col("result").alias("reason")
    )
    # a message without a template is skipped, it does not count as a failure
    outcomes = table.filter(F.col("parse_status") == "ok").select(
        "user_id", F.when(F.col("result") == "ok", "stored").otherwise("failed").alias("status")
    )
    summary = stamped = None
    if users is not None:
        summary = reports.run_summary(outcomes, rules.enabled_users(users))
        stamped = ledger.stamp_sync(users, summary.filter("ok"), as_of)
    if isinstance(ledger_table, LedgerTable):
        accepted = reliable_checkpoint(accepted, "accepted")
    updated = _stored(ledger_table, accepted, as_of, ["date", "id_api"])
    return Loaded(updated, accepted, rejected, outcomes, summary, stamped)


def export_training(
    ledger_table: DataFrame, users: DataFrame, feedback: DataFrame, table_path: str, files_path: str, as_of, days: int = FULL_EXPORT_DAYS,
    dedup: bool = True,
) -> DataFrame:
    """Ledger to the warehouse table, and the table with feedback to training files."""
    clock = dates.as_clock(as_of)
    rows = labels.export_rows(ledger_table, users, dates.days_before(clock, days), clock)
    writers.write_training_table(rows, table_path)
    return export_files(ledger_table.sparkSession, feedback, table_path, files_path, as_of, days, dedup, rows.schema)


def export_files(spark: SparkSession, feedback: DataFrame, table_path: str, files_path: str, as_of, days: int, dedup: bool = True, schema=None) -> DataFrame:
    """The warehouse table's last ``days`` with feedback to training files. Only the partitions of these days are read,
    before exports are de-duplicated, and the files are in no order."""
    clock = dates.as_clock(as_of)
    start = F.date_sub(F.to_date(clock), days)
    table = writers.read_training_table(spark, table_path, schema, start)
    table = labels.newest_export(table) if dedup else table
    training = labels.with_feedback(table, feedback, start, F.to_date(clock), ordered=False)
    writers.write_training_files(training, files_path)
    return spark.read.parquet(files_path)


EXPORT_DAY = "export_day"


def export_all(ledger_table: DataFrame, users: DataFrame, feedback: DataFrame, table_path: str, files_path: str, as_of, keep_days: int = KEEP_DAYS) -> DataFrame:
    """The full action: the ledger to the warehouse, training files in a folder of the day of ``as_of``, and the folders of
    exports more than ``keep_days`` old removed. Returns this export's rows."""
    day = datetime.datetime.fromisoformat(as_of).date()
    rows = export_training(ledger_table, users, feedback, table_path, f"{files_path}/{EXPORT_DAY}={day}", as_of)
    writers.drop_days_before(ledger_table.sparkSession, files_path, EXPORT_DAY, day - datetime.timedelta(days=keep_days))
    return rows


def export_incremental(ledger_table: DataFrame, users: DataFrame, table_path: str, as_of) -> None:
    """The weekly action: the last days are appended to the warehouse table; training files stay as they are."""
    clock = dates.as_clock(as_of)
    writers.write_training_table(labels.export_rows(ledger_table, users, dates.days_before(clock, INCREMENTAL_EXPORT_DAYS), clock), table_path)


def export_stats(spark: SparkSession, table_path: str) -> DataFrame:
    """The statistics action over the warehouse table."""
    return reports.training_stats(writers.read_training_table(spark, table_path))


def update_daily_stats(spark: SparkSession, rows: DataFrame, stats_path: str) -> None:
    """Keep one row a day of the warehouse table, in a folder a year. ``rows`` are whole years of it, which are replaced."""
    days = reports.daily_stats(rows).withColumn("year", F.year("day"))
    days.repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(stats_path)


def export_daily_stats(spark: SparkSession, stats_path: str) -> DataFrame:
    """The statistics action over the rows of ``update_daily_stats``."""
    return reports.stats_of_days(spark.read.parquet(stats_path))


def prepare_training(source: DataFrame, user_ids=None, start=None, end=None, limit_per_user=None) -> DataFrame:
    """Ledger rows to the labelled training layout."""
    return rules.prepare_training_rows(readers.scan_ledger(source, user_ids, start, end, limit_per_user))


@dataclass
class Corrected:
    ledger: DataFrame
    feedback: DataFrame
    categories: DataFrame


def correct(ledger_table: DataFrame, corrections: DataFrame, as_of) -> Corrected:
    """Corrections onto the ledger, feedback rows for the changed labels, and the category index after it."""
    changed = labels.apply_corrections(ledger_table, corrections, as_of)
    return Corrected(changed, labels.feedback_rows(ledger_table, corrections), reports.category_index(changed))


def monitoring_cycle(predictions: DataFrame, feedback: DataFrame, as_of) -> DataFrame:
    """All monitoring reports as metric points."""
    clock = dates.as_clock(as_of)
    hourly = reports.to_metrics(
        reports.hourly_prediction_metrics(predictions, as_of),
        {"predictions": "predictions_per_hour", "avg_confidence": "avg_confidence", "unique_users": "unique_users",
         "unique_categories": "category_diversity"},
        ["model_version"], clock,
    )
    daily = reports.to_metrics(
        reports.daily_feedback_metrics(feedback, as_of),
        {"feedback_count": "feedback_count", "accuracy": "accuracy", "users_providing_feedback": "users_providing_feedback"},
        ["model_version", "date"], clock,
    )
    categories = reports.to_metrics(
        reports.category_performance(predictions, as_of),
        {"predictions": "category_predictions", "avg_confidence": "category_confidence"},
        ["category", "model_version"], clock,
    )
    drift = reports.model_drift(feedback, as_of).filter("drift_detected").withColumn("alert", F.lit(1.0))
    alerts = reports.to_metrics(drift, {"alert": "model_drift_detected"}, ["model_version"], clock)
    return hourly.unionByName(daily).unionByName(categories).unionByName(alerts)


def metrics_report(feedback: DataFrame, as_of, days: int = 30, by_category: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Feedback statistics and, when asked for, the accuracy per category."""
    return reports.feedback_stats(feedback, as_of, days), reports.category_accuracy(feedback, as_of) if by_category else None


def train(training: DataFrame, settings: model.Settings | None = None) -> model.Trained:
    """Check, balance, weight, split by time, fit both classifiers and score the held-out rows."""
    settings = settings or model.Settings()
    lacking = reports.missing_columns(training)
    if lacking:
        raise ValueError(f"Missing required columns: {[name for name, _ in lacking]}")
    diversity = reports.diversity_grade(training).first()
    if diversity["grade"] == "critical":
        raise ValueError(f"Training needs at least two categories, found {diversity['unique_categories']}")
    # the split reads the balanced rows several times
    balanced = reliable_checkpoint(sampling.with_weights(sampling.balance_categories(training)), "balanced")
    parts = sampling.split_by_time(balanced)
    return model.fit(parts.filter("is_train"), parts.filter("NOT is_train"), settings)


def ingest(requests: DataFrame, ledger_table: DataFrame | LedgerTable, scorer, as_of) -> Loaded:
    """Ingest requests: those that pass the gate are scored, written in ledger layout and merged; rejected ones keep their
    error. ``scorer`` appends category, subcategory, confidence and model_version."""
    scored = rules.apply_prediction(scorer(spread(rules.accept_requests(requests))))
    good, bad = ledger.split_writable(scored)
    accepted = reliable_checkpoint(ledger.ledger_rows(good, as_of), "ingested")
    return Loaded(_stored(ledger_table, accepted, as_of, ["date"]), accepted, bad, rules.ingest_errors(requests))


def retrain_from_ledger(
    ledger_table: DataFrame, users: DataFrame, feedback: DataFrame, table_path: str, files_path: str, registry_path: str, model_path: str, as_of,
    min_feedback: int = 100, days: int = 7, settings: model.Settings | None = None,
) -> str | None:
    """The whole retraining: ledger and feedback are exported, and the model is trained on the files that gives."""
    training = export_training(ledger_table, users, feedback, table_path, files_path, as_of)
    return retrain(ledger_table.sparkSession, training, feedback, registry_path, model_path, as_of, min_feedback, days, settings)


def retrain(
    spark: SparkSession, training: DataFrame, feedback: DataFrame, registry_path: str, model_path: str, as_of,
    min_feedback: int = 100, days: int = 7, settings: model.Settings | None = None,
) -> str | None:
    """Train and register a new model when there is enough feedback; returns its name."""
    gate = reports.has_sufficient_feedback(feedback, as_of, min_feedback, days)
    if not gate.first()["sufficient"]:
        return None
    trained = train(training, settings)
    known = spark.read.schema("model_id STRING").parquet(registry_path)
    version = reports.next_version(known).first()["next_version"]
    name = f"transaction_model_v{version}"
    trained.save(f"{model_path.rstrip('/')}/{name}")
    entry = spark.range(1).select(
        F.lit(name).alias("model_id"), F.lit(int(version)).alias("version"), F.lit("testing").alias("status"),
        F.lit(20).alias("traffic_percentage"), dates.as_clock(as_of).alias("created_at"), dates.as_clock(as_of).alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("promoted_at"), F.lit(f"{model_path.rstrip('/')}/{name}").alias("path"),
    )
    writers.append_rows(entry, registry_path)
    return name
