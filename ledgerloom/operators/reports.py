"""Monitoring, accuracy, drift and data-quality reports.

Distinct counts are exact. Spark plans them as two partial aggregates, the first keyed by the distinct value
too, so neither a hot group nor a hot value gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from .rules import UNCATEGORIZED

# Alert levels of the drift score.
DRIFT_YELLOW, DRIFT_RED = 0.5, 1.0


def _agrees() -> Column:
    return F.col("original_category") == F.col("user_category")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _since(df: DataFrame, column: str, days: int, as_of) -> DataFrame:
    return df.filter(F.col(column) > dates.days_before(dates.as_clock(as_of), days))


# ---------------------------------------------------------------------------------------- training stats


def _distinct(column: str, approximate: bool):
    return F.approx_count_distinct(column) if approximate else F.count_distinct(column)


def training_stats(training: DataFrame, approximate: bool = False) -> DataFrame:
    return training.agg(
        F.count("*").alias("total_records"),
        _distinct("user_id", approximate).alias("unique_users"),
        _distinct("category", approximate).alias("unique_categories"),
        _distinct("subcategory", approximate).alias("unique_subcategories"),
        F.count_if("is_user_corrected").alias("user_corrected_count"),
        F.min("date").alias("earliest_date"),
        F.max("date").alias("latest_date"),
    )


_SKETCHED = {"user_id": "unique_users", "category": "unique_categories", "subcategory": "unique_subcategories"}


def daily_stats(training: DataFrame) -> DataFrame:
    """One row a day whose counts can be added and whose sketches can be merged."""
    sketches = [F.hll_sketch_agg(column).alias(name) for column, name in _SKETCHED.items()]
    return training.groupBy(F.to_date("date").alias("day")).agg(
        F.count("*").alias("total_records"), F.count_if("is_user_corrected").alias("user_corrected_count"),
        F.min("date").alias("earliest_date"), F.max("date").alias("latest_date"), *sketches,
    )


def stats_of_days(days: DataFrame) -> DataFrame:
    """``training_stats`` from ``daily_stats``, without reading the history again. Distinct counts are estimates, within
    some 3 % of the true number."""
    sketches = [F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in _SKETCHED.values()]
    return days.agg(
        F.sum("total_records").alias("total_records"), *sketches, F.sum("user_corrected_count").alias("user_corrected_count"),
        F.min("earliest_date").alias("earliest_date"), F.max("latest_date").alias("latest_date"),
    )


# ---------------------------------------------------------------------------------------------- feedback


def feedback_stats(feedback: DataFrame, as_of, days: int = 30, approximate: bool = False) -> DataFrame:
    recent = _since(feedback, "feedback_timestamp", days, as_of)
    stats = recent.agg(
        F.count("*").alias("total_feedback"),
        _distinct("user_id", approximate).alias("unique_users"),
        _distinct("transaction_id", approximate).alias("unique_transactions"),
        F.coalesce(F.avg("prediction_confidence"), F.lit(0.0)).alias("avg_confidence"),
        _distinct("model_version", approximate).alias("model_versions"),
        F.count_if(F.col("original_category") != F.col("user_category")).alias("category_changes"),
        _distinct("user_category", approximate).alias("unique_categories"),
    )
    changed = _share(F.col("category_changes"), F.col("total_feedback"))
    return stats.withColumn("accuracy_rate", F.coalesce(1 - changed, F.lit(0.0)))


def category_accuracy(feedback: DataFrame, as_of, model_version: str | None = None, days: int = 30) -> DataFrame:
    recent = _since(feedback, "feedback_timestamp", days, as_of)
    if model_version:
        recent = recent.filter(F.col("model_version") == model_version)
    return (
        recent.groupBy("original_category")
        .agg(
            F.count("*").alias("total"),
            F.count_if(_agrees()).alias("correct"),
            F.count_distinct("user_category").alias("confusion_count"),
        )
        .withColumn("accuracy", F.col("correct") / F.col("total"))
        .orderBy(F.desc("total"), "original_category")
    )


def daily_feedback_metrics(feedback: DataFrame, as_of, days: int = 7) -> DataFrame:
    return (
        _since(feedback, "feedback_timestamp", days, as_of)
        .groupBy(F.to_date("feedback_timestamp").alias("date"), "model_version")
        .agg(
            F.count("*").alias("feedback_count"),
            F.count_if(_agrees()).alias("correct"),
            F.count_distinct("user_id").alias("users_providing_feedback"),
        )
        .withColumn("accuracy", F.round(F.col("correct") / F.col("feedback_count"), 3))
        .orderBy(F.desc("date"), "model_version")
    )


def has_sufficient_feedback(feedback: DataFrame, as_of, min_count: int = 100, days: int = 7) -> DataFrame:
    counted = _since(feedback, "feedback_timestamp", days, as_of).agg(F.count("*").alias("feedback_count"))
    return counted.withColumn("sufficient", F.col("feedback_count") >= min_count)


# ------------------------------------------------------------------------------------------- predictions


def hourly_prediction_metrics(predictions: DataFrame, as_of, hours: int = 24) -> DataFrame:
    recent = predictions.filter(F.col("created_at") > dates.hours_before(dates.as_clock(as_of), hours))
    return (
        recent.groupBy(dates.hour_of(F.col("created_at")).alias("hour"), "model_version")
        .agg(
            F.count("*").alias("predictions"),
            F.avg("prediction_confidence").alias("avg_confidence"),
            F.count_distinct("user_id").alias("unique_users"),
            F.count_distinct("category").alias("unique_categories"),
        )
        .orderBy(F.desc("hour"), "model_version")
    )


def category_performance(predictions: DataFrame, as_of, days: int = 1, min_predictions: int = 10) -> DataFrame:
    return (
        _since(predictions, "created_at", days, as_of)
        .groupBy("category", "model_version")
        .agg(F.count("*").alias("predictions"), F.avg("prediction_confidence").alias("avg_confidence"))
        .filter(F.col("predictions") > min_predictions)
        .orderBy(F.desc("predictions"), "category", "model_version")
    )


# -------------------------------------------------------------------------------------------------- drift


def _rounded_accuracy(prefix: str) -> Column:
    share = F.count_if(_agrees()) / F.count("*")
    return F.round(share, 3).cast("decimal(9,3)").alias(prefix)


def model_drift(
    feedback: DataFrame, as_of, recent_days: int = 1, baseline_days: int = 7, threshold: float = -0.05
) -> DataFrame:
    """Accuracy of the newest days against the days before, per model. Both are decimals with three places,
    so a change of exactly the threshold is not drift."""
    clock = dates.as_clock(as_of)
    edge, begin = dates.days_before(clock, recent_days), dates.days_before(clock, baseline_days)
    at = F.col("feedback_timestamp")
    recent = feedback.filter(at > edge).groupBy("model_version").agg(
        _rounded_accuracy("recent_accuracy"), F.count("*").alias("sample_size")
    )
    baseline = feedback.filter(at.between(begin, edge)).groupBy("model_version").agg(
        _rounded_accuracy("baseline_accuracy")
    )
    change = F.col("recent_accuracy") - F.col("baseline_accuracy")
    return recent.join(baseline, "model_version").select(
        "model_version",
        "recent_accuracy",
        "baseline_accuracy",
        change.alias("accuracy_change"),
        "sample_size",
        (change < F.lit(str(threshold)).cast("decimal(9,3)")).alias("drift_detected"),
    )


def drift_level(score: Column) -> Column:
    return F.when(score >= DRIFT_RED, "RED").when(score >= DRIFT_YELLOW, "YELLOW").otherwise("GREEN")


def model_performance(feedback: DataFrame, as_of, days: int = 7, order: str = "number") -> DataFrame:
    """Accuracy of the two newest models. ``order='name'`` ranks by the text of the name, in which v9 comes
    after v10."""
    per_model = (
        _since(feedback, "feedback_timestamp", days, as_of)
        .groupBy("model_version")
        .agg(F.count("*").alias("total_predictions"), F.count_if(_agrees()).alias("correct_predictions"))
        .withColumn("accuracy", F.round(F.col("correct_predictions") / F.col("total_predictions"), 3))
    )
    rank = F.col("model_version") if order == "name" else text.model_number(F.col("model_version"))
    return per_model.orderBy(rank.desc_nulls_last(), F.desc("model_version")).limit(2)


def promotion_decision(feedback: DataFrame, as_of, gain: float = 1.05, days: int = 7, order: str = "number") -> DataFrame:
    """``promoted`` when the newest model beats the one before it by the factor ``gain``; with fewer than two
    models both accuracies are 0 and nothing is promoted."""
    pair = model_performance(feedback, as_of, days, order)
    rank = F.col("model_version") if order == "name" else text.model_number(F.col("model_version"))
    sides = pair.agg(
        F.count("*").alias("_n"),
        F.max_by("accuracy", rank).alias("_new"),
        F.min_by("accuracy", rank).alias("_current"),
    )
    both = F.col("_n") >= 2
    return sides.select(
        F.when(both, F.col("_new")).otherwise(0.0).alias("new_model_accuracy"),
        F.when(both, F.col("_current")).otherwise(0.0).alias("current_model_accuracy"),
        F.when(both & (F.col("_new") > F.col("_current") * gain), "promoted").otherwise("monitoring").alias("status"),
    )


# ------------------------------------------------------------------------------------- counts and quality


def category_index(ledger: DataFrame) -> DataFrame:
    """Per user and category in force: rows and last use, newest first."""
    category = F.coalesce("user_category", "predicted_category", F.lit(UNCATEGORIZED))
    return (
        ledger.groupBy("user_id", category.alias("category"))
        .agg(F.count("*").alias("transaction_count"), F.max("last_modified").alias("last_used"))
        .orderBy("user_id", F.desc_nulls_last("last_used"), "category")
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Values by frequency with their share of all rows; NULL is not counted as a value.

    The total is a scalar from the same counts, not a second scan and not a window over all groups."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    out = (
        counts.filter(F.col("value").isNotNull())
        .select("value", "n", (F.col("n") / total).alias("share"))
        .orderBy(F.desc("n"), "value")
    )
    return out.limit(top) if top else out


def quality_profile(df: DataFrame) -> DataFrame:
    """Long table (metric, value) about a training set; one pass over the rows."""
    n = F.count("*")
    category = "category" if "category" in df.columns else "user_category"
    metrics = {"rows": n}
    for name in ("category", "subcategory", "vendor", "amount", "user_id"):
        if name in df.columns:
            metrics[f"null_share_{name}"] = _share(F.count_if(F.col(name).isNull()), n)
    if "category" in df.columns:
        metrics["uncategorized"] = F.count_if(F.col("category") == UNCATEGORIZED)
    elif "user_category" in df.columns:
        metrics["uncategorized"] = F.count_if(F.col("user_category").isNull())
    if "uncategorized" in metrics:
        metrics["uncategorized_share"] = _share(metrics["uncategorized"], n)
    if "is_user_corrected" in df.columns:
        metrics["corrected"] = F.count_if("is_user_corrected")
        metrics["corrected_share"] = _share(F.count_if("is_user_corrected"), n)
    for name in ("user_category", "user_subcategory"):
        if name in df.columns:
            metrics[f"share_{name}"] = _share(F.count(name), n)
    metrics["unique_categories"] = F.count_distinct(category)
    metrics["unique_users"] = F.count_distinct("user_id")
    wide = df.agg(*[c.cast("double").alias(m) for m, c in metrics.items()])
    return wide.unpivot([], list(metrics), "metric", "value")


def missing_columns(df: DataFrame) -> list[tuple[str, str | None]]:
    """Required columns that a training set lacks, each with the column that could stand in for it."""
    aliases = {
        "category": ["predicted_category", "user_category"],
        "subcategory": ["predicted_subcategory", "user_subcategory"],
        "account": ["account_id"],
    }
    found = set(df.columns)
    out = []
    for name in ("category", "subcategory", "vendor", "amount", "user_id"):
        if name not in found and f"user_{name}" not in found:
            out.append((name, next((a for a in aliases.get(name, []) if a in found), None)))
    return out


def diversity_grade(df: DataFrame, column: str = "category") -> DataFrame:
    """Fewer than 2 categories is critical, fewer than 5 a warning."""
    n = F.col("unique_categories")
    return df.agg(F.count_distinct(column).alias("unique_categories")).withColumn(
        "grade", F.when(n < 2, "critical").when(n < 5, "warning").otherwise("good")
    )


def set_summary(df: DataFrame) -> DataFrame:
    """Head of the training-set report; category shares and top vendors come from ``value_counts``."""
    return df.agg(
        F.count("*").alias("total"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_if("is_user_corrected").alias("corrected"),
        F.avg(F.col("is_user_corrected").cast("double")).alias("corrected_share"),
    )


def set_report(df: DataFrame, top: int = 10) -> DataFrame:
    """The whole report as one long table (section, item, n, share)."""
    head = set_summary(df).select(
        F.lit("summary").alias("section"), F.lit("corrected").alias("item"), F.col("corrected").alias("n"),
        F.col("corrected_share").alias("share"),
    )
    shape = lambda section, counts: counts.select(F.lit(section).alias("section"), F.col("value").alias("item"), "n", "share")
    return head.unionByName(shape("category", value_counts(df, "category"))).unionByName(
        shape("vendor", value_counts(df, "vendor_cleaned", top))
    )


def run_summary(outcomes: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: messages stored and failed. A user is ok with a stored row or with nothing to do."""
    counts = outcomes.groupBy("user_id").agg(
        F.count_if(F.col("status") == "stored").alias("stored"), F.count_if(F.col("status") != "stored").alias("failed")
    )
    stored, failed = F.coalesce("stored", F.lit(0)), F.coalesce("failed", F.lit(0))
    return users.select("user_id").join(counts, "user_id", "left").select(
        "user_id", stored.alias("stored"), failed.alias("failed"), ((stored > 0) | (failed == 0)).alias("ok")
    )


def run_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count("*").alias("processed_users"),
        F.count_if("ok").alias("users_ok"),
        F.count_if(~F.col("ok")).alias("users_failed"),
        F.coalesce(F.sum("stored"), F.lit(0)).alias("messages_ok"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("messages_failed"),
    )


# ------------------------------------------------------------------------------------ classifier reports


def classification_accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy")
    )


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from one confusion aggregate; undefined ratios are 0."""
    confusion = df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("called"), hit.alias("hit")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).alias("support"), F.col("n").alias("called"), F.lit(0).alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    totals = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        totals.withColumn("precision", zero(_share(F.col("hit"), F.col("called"))))
        .withColumn("recall", zero(_share(F.col("hit"), F.col("support"))))
        .withColumn(
            "f1", zero(_share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        )
        .select("class", "precision", "recall", "f1", "support")
        .orderBy("class")
    )


# ----------------------------------------------------------------------------------------------- metrics


def to_metrics(report: DataFrame, metrics: dict[str, str], labels: list[str], ts: Column) -> DataFrame:
    """Wide report to long metric points (metric, value, labels, ts); ``metrics`` maps column to metric name."""
    pairs = [x for name in labels for x in (F.lit(name), F.col(name).cast("string"))]
    wide = report.select(
        F.create_map(*pairs).alias("labels") if pairs else F.create_map().cast("map<string,string>").alias("labels"),
        ts.alias("ts"),
        *[F.col(c).cast("double").alias(m) for c, m in metrics.items()],
    )
    return wide.unpivot(["labels", "ts"], list(metrics.values()), "metric", "value").select("metric", "value", "labels", "ts")


# How each dashboard series is aligned, as (metric, seconds, aggregate, label to group by).
SERIES = [
    ("accuracy", 3600, "mean", None),
    ("predictions_per_hour", 3600, "sum", None),
    ("avg_confidence", 3600, "mean", None),
    ("feedback_count", 86400, "sum", None),
    ("category_predictions", 3600, "sum", "category"),
    ("model_drift_detected", 3600, "max", None),
]


def align_series(points: DataFrame, series=None) -> DataFrame:
    """Metric points in time buckets. A series without a grouping label keeps one line per label set."""
    series = series or SERIES
    seconds, group, how = F.lit(3600), F.to_json("labels"), F.lit("mean")
    for metric, width, aggregate, label in series:
        hit = F.col("metric") == metric
        seconds = F.when(hit, F.lit(width)).otherwise(seconds)
        how = F.when(hit, F.lit(aggregate)).otherwise(how)
        if label:
            group = F.when(hit, F.col("labels")[label]).otherwise(group)
    wanted = [s[0] for s in series]
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.col("_width")) * F.col("_width"))
    buckets = (
        points.filter(F.col("metric").isin(wanted))
        .withColumns({"_width": seconds, "_how": how, "series": group})
        .groupBy("metric", "series", "_how", start.cast("timestamp_ntz").alias("bucket"))
        .agg(F.avg("value").alias("_mean"), F.sum("value").alias("_sum"), F.max("value").alias("_max"))
    )
    value = F.when(F.col("_how") == "mean", F.col("_mean")).when(F.col("_how") == "sum", F.col("_sum")).otherwise(F.col("_max"))
    return buckets.select("metric", "series", "bucket", value.alias("value"))


# ---------------------------------------------------------------------------------------------- registry


def current_model(registry: DataFrame, status: str | None = None) -> DataFrame:
    """The entry with the highest version number."""
    entries = registry.filter(F.col("status") == status) if status else registry
    row = F.max_by(F.struct(*registry.columns), F.struct("version", "created_at")).alias("row")
    return entries.agg(row).filter("row IS NOT NULL").select("row.*")


def next_version(models: DataFrame, name: str = "model_id") -> DataFrame:
    """Highest model number plus one, 1 when there is none."""
    return models.agg(F.coalesce(F.max(text.model_number(F.col(name))) + 1, F.lit(1)).alias("next_version"))


def promote(registry: DataFrame, decision: DataFrame, as_of) -> DataFrame:
    """Registry with the newest entry in production when the decision says so."""
    newest = registry.agg(F.max("version")).scalar()
    promoted = decision.select(F.first("status") == "promoted").scalar()
    hit = (F.col("version") == newest) & F.coalesce(promoted, F.lit(False))
    clock = dates.as_clock(as_of)
    return registry.withColumns(
        {
            "status": F.when(hit, "production").otherwise(F.col("status")),
            "traffic_percentage": F.when(hit, 100).otherwise(F.col("traffic_percentage")),
            "promoted_at": F.when(hit, clock).otherwise(F.col("promoted_at")),
        }
    )


def majority_label(df: DataFrame, key: str = "vendor_cleaned", label: str = "category") -> DataFrame:
    """Most frequent label per key, ties to the first by name: the baseline a model has to beat."""
    counts = df.groupBy(key, label).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(F.col(label), F.col("n")), F.struct((-F.col("n")).alias("a"), F.col(label).alias("b")))
    return counts.groupBy(key).agg(best.alias("best"), F.sum("n").alias("total")).select(
        key, F.col(f"best.{label}").alias("majority"), F.col("best.n").alias("votes"), "total"
    )


