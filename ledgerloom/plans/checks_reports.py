"""Registered reports: monitoring, accuracy, drift, quality."""

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import reports
from .registry import register, rounded
from .views import AS_OF, FB_SQL, PRED_SQL, TD_SQL, TX_SQL, USR_SQL, fb, pred, td, tx, usr

NOW = f"TIMESTAMP '{AS_OF}'"
CLEAN = "trim(regexp_replace(lower(vendor), '[^a-z]+', ' ', 'g'))"


@register(
    "a1_training_stats",
    """SELECT count(*) AS total_records, count(DISTINCT user_id) AS unique_users,
       count(DISTINCT category) AS unique_categories, count(DISTINCT subcategory) AS unique_subcategories,
       count(*) FILTER (WHERE is_user_corrected) AS user_corrected_count,
       min(date) AS earliest_date, max(date) AS latest_date FROM td""",
    [TD_SQL],
)
def a1(spark, sf):
    return reports.training_stats(td(spark, sf))


@register(
    "a2_feedback_stats",
    f"""SELECT count(*) AS total_feedback, count(DISTINCT user_id) AS unique_users,
       count(DISTINCT transaction_id) AS unique_transactions, round(coalesce(avg(prediction_confidence), 0), 6) AS avg_confidence,
       count(DISTINCT model_version) AS model_versions,
       count(*) FILTER (WHERE original_category <> user_category) AS category_changes,
       count(DISTINCT user_category) AS unique_categories,
       round(coalesce(1 - count(*) FILTER (WHERE original_category <> user_category) / nullif(count(*), 0), 0), 6) AS accuracy_rate
       FROM fb WHERE feedback_timestamp > {NOW} - INTERVAL 30 DAY""",
    [FB_SQL],
)
def a2(spark, sf):
    return rounded(reports.feedback_stats(fb(spark, sf), AS_OF), "avg_confidence", "accuracy_rate")


@register(
    "a3_category_accuracy",
    f"""SELECT original_category, count(*) AS total, count(*) FILTER (WHERE original_category = user_category) AS correct,
       count(DISTINCT user_category) AS confusion_count,
       round(count(*) FILTER (WHERE original_category = user_category) / count(*), 6) AS accuracy
       FROM fb WHERE feedback_timestamp > {NOW} - INTERVAL 30 DAY GROUP BY 1""",
    [FB_SQL],
)
def a3(spark, sf):
    return rounded(reports.category_accuracy(fb(spark, sf), AS_OF), "accuracy")


@register(
    "a3_category_accuracy_one_model",
    f"""SELECT original_category, count(*) AS total, count(*) FILTER (WHERE original_category = user_category) AS correct,
       count(DISTINCT user_category) AS confusion_count,
       round(count(*) FILTER (WHERE original_category = user_category) / count(*), 6) AS accuracy
       FROM fb WHERE feedback_timestamp > {NOW} - INTERVAL 30 DAY AND model_version = 'transaction_model_v9' GROUP BY 1""",
    [FB_SQL],
)
def a3_model(spark, sf):
    return rounded(reports.category_accuracy(fb(spark, sf), AS_OF, "transaction_model_v9"), "accuracy")


HOURLY_SQL = f"""SELECT date_trunc('hour', created_at) AS hour, model_version, count(*) AS predictions,
       round(avg(prediction_confidence), 6) AS avg_confidence, count(DISTINCT user_id) AS unique_users,
       count(DISTINCT category) AS unique_categories
       FROM pred WHERE created_at > {NOW} - INTERVAL 24 HOUR GROUP BY 1, 2"""


@register("a4_hourly_prediction_metrics", HOURLY_SQL, [PRED_SQL])
def a4(spark, sf):
    return rounded(reports.hourly_prediction_metrics(pred(spark, sf), AS_OF), "avg_confidence")


DAILY_SQL = f"""SELECT CAST(feedback_timestamp AS DATE) AS date, model_version, count(*) AS feedback_count,
       count(*) FILTER (WHERE original_category = user_category) AS correct,
       count(DISTINCT user_id) AS users_providing_feedback,
       round(count(*) FILTER (WHERE original_category = user_category) / count(*), 3) AS accuracy
       FROM fb WHERE feedback_timestamp > {NOW} - INTERVAL 7 DAY GROUP BY 1, 2"""


@register("a5_daily_feedback_metrics", DAILY_SQL, [FB_SQL])
def a5(spark, sf):
    return reports.daily_feedback_metrics(fb(spark, sf), AS_OF)


CATEGORY_SQL = f"""SELECT category, model_version, count(*) AS predictions, round(avg(prediction_confidence), 6) AS avg_confidence
       FROM pred WHERE created_at > {NOW} - INTERVAL 1 DAY GROUP BY 1, 2 HAVING count(*) > 10"""


@register("a6_category_performance", CATEGORY_SQL, [PRED_SQL])
def a6(spark, sf):
    return rounded(reports.category_performance(pred(spark, sf), AS_OF), "avg_confidence")


DRIFT_SQL = f"""r AS (
  SELECT model_version, CAST(round(count(*) FILTER (WHERE original_category = user_category) / count(*), 3) AS DECIMAL(9,3)) AS recent_accuracy,
         count(*) AS sample_size FROM fb WHERE feedback_timestamp > {NOW} - INTERVAL 1 DAY GROUP BY 1),
b AS (
  SELECT model_version, CAST(round(count(*) FILTER (WHERE original_category = user_category) / count(*), 3) AS DECIMAL(9,3)) AS baseline_accuracy
  FROM fb WHERE feedback_timestamp BETWEEN {NOW} - INTERVAL 7 DAY AND {NOW} - INTERVAL 1 DAY GROUP BY 1),
drift AS (
  SELECT model_version, CAST(recent_accuracy AS DOUBLE) AS recent_accuracy, CAST(baseline_accuracy AS DOUBLE) AS baseline_accuracy,
         round(CAST(recent_accuracy - baseline_accuracy AS DOUBLE), 6) AS accuracy_change, sample_size,
         recent_accuracy - baseline_accuracy < -0.05 AS drift_detected
  FROM r JOIN b USING (model_version))"""


def _drift(spark, sf):
    return rounded(
        reports.model_drift(fb(spark, sf), AS_OF), "recent_accuracy", "baseline_accuracy", "accuracy_change"
    )


@register("a7_model_drift", "SELECT * FROM drift", [FB_SQL, DRIFT_SQL])
def a7(spark, sf):
    return _drift(spark, sf)


@register(
    "j4_recent_baseline_join",
    "SELECT model_version, recent_accuracy, baseline_accuracy FROM drift",
    [FB_SQL, DRIFT_SQL],
)
def j4(spark, sf):
    return _drift(spark, sf).select("model_version", "recent_accuracy", "baseline_accuracy")


PERF_SQL = f"""perf AS (
  SELECT model_version, count(*) AS total_predictions, count(*) FILTER (WHERE original_category = user_category) AS correct_predictions,
         round(count(*) FILTER (WHERE original_category = user_category) / count(*), 3) AS accuracy,
         CAST(split_part(model_version, '_v', 2) AS INTEGER) AS number
  FROM fb WHERE feedback_timestamp > {NOW} - INTERVAL 7 DAY GROUP BY 1)"""


@register(
    "a8_model_performance",
    "SELECT model_version, total_predictions, correct_predictions, accuracy FROM perf ORDER BY number DESC LIMIT 2",
    [FB_SQL, PERF_SQL],
)
def a8(spark, sf):
    return reports.model_performance(fb(spark, sf), AS_OF)


@register(
    "a8_model_performance_by_name",
    "SELECT model_version, total_predictions, correct_predictions, accuracy FROM perf ORDER BY model_version DESC LIMIT 2",
    [FB_SQL, PERF_SQL],
)
def a8_name(spark, sf):
    return reports.model_performance(fb(spark, sf), AS_OF, order="name")


@register(
    "m7_promotion_decision",
    """, two AS (SELECT * FROM perf ORDER BY number DESC LIMIT 2)
    SELECT max(accuracy) FILTER (WHERE number = 10) AS new_model_accuracy, max(accuracy) FILTER (WHERE number = 9) AS current_model_accuracy,
    CASE WHEN max(accuracy) FILTER (WHERE number = 10) > max(accuracy) FILTER (WHERE number = 9) * 1.05 THEN 'promoted'
         ELSE 'monitoring' END AS status FROM two""",
    [FB_SQL, PERF_SQL],
)
def m7(spark, sf):
    return reports.promotion_decision(fb(spark, sf), AS_OF)


@register(
    "a9_sufficient_feedback",
    f"""SELECT count(*) AS feedback_count, count(*) >= 100 AS sufficient FROM fb
    WHERE feedback_timestamp > {NOW} - INTERVAL 7 DAY""",
    [FB_SQL],
)
def a9(spark, sf):
    return reports.has_sufficient_feedback(fb(spark, sf), AS_OF)


@register(
    "a10_category_index",
    """SELECT user_id, coalesce(user_category, predicted_category, 'Uncategorized') AS category,
    count(*) AS transaction_count, max(last_modified) AS last_used FROM tx GROUP BY 1, 2""",
    [TX_SQL],
)
def a10(spark, sf):
    return reports.category_index(tx(spark, sf))


@register(
    "a11_value_counts",
    "SELECT category AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM td), 6) AS share FROM td GROUP BY 1",
    [TD_SQL],
)
def a11(spark, sf):
    return rounded(reports.value_counts(td(spark, sf), "category"), "share")


@register(
    "o3_top_vendors",
    f"""SELECT {CLEAN} AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM tx), 6) AS share
    FROM tx GROUP BY 1 ORDER BY n DESC, value LIMIT 10""",
    [TX_SQL],
)
def o3(spark, sf):
    from ..functions import text

    cleaned = tx(spark, sf).withColumn("vendor_cleaned", text.clean_vendor(F.col("vendor")))
    return rounded(reports.value_counts(cleaned, "vendor_cleaned", 10), "share")


@register(
    "a12_label_sources",
    """SELECT count(user_category) AS from_user,
    count(*) FILTER (WHERE user_category IS NULL AND predicted_category <> 'Uncategorized') AS from_prediction,
    count(*) FILTER (WHERE user_category IS NULL AND predicted_category = 'Uncategorized') AS uncategorized FROM tx""",
    [TX_SQL],
)
def a12(spark, sf):
    from ..operators import labels

    return labels.label_sources(tx(spark, sf))


@register(
    "a13_quality_profile",
    """, w AS (SELECT CAST(count(*) AS DOUBLE) AS rows,
    count(*) FILTER (WHERE category IS NULL) / count(*) AS null_share_category,
    count(*) FILTER (WHERE subcategory IS NULL) / count(*) AS null_share_subcategory,
    count(*) FILTER (WHERE vendor IS NULL) / count(*) AS null_share_vendor,
    count(*) FILTER (WHERE amount IS NULL) / count(*) AS null_share_amount,
    count(*) FILTER (WHERE user_id IS NULL) / count(*) AS null_share_user_id,
    CAST(count(*) FILTER (WHERE category = 'Uncategorized') AS DOUBLE) AS uncategorized,
    count(*) FILTER (WHERE category = 'Uncategorized') / count(*) AS uncategorized_share,
    CAST(count(*) FILTER (WHERE is_user_corrected) AS DOUBLE) AS corrected,
    count(*) FILTER (WHERE is_user_corrected) / count(*) AS corrected_share,
    count(user_category) / count(*) AS share_user_category, count(user_subcategory) / count(*) AS share_user_subcategory,
    CAST(count(DISTINCT category) AS DOUBLE) AS unique_categories, CAST(count(DISTINCT user_id) AS DOUBLE) AS unique_users
    FROM td)
    SELECT metric, round(value, 6) AS value FROM (UNPIVOT w ON COLUMNS(*) INTO NAME metric VALUE value)""",
    [TD_SQL],
)
def a13(spark, sf):
    return rounded(reports.quality_profile(td(spark, sf)), "value")


@register(
    "a13_rows_per_user",
    "SELECT user_id AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM td), 8) AS share FROM td GROUP BY 1",
    [TD_SQL],
)
def a13_users(spark, sf):
    return rounded(reports.value_counts(td(spark, sf), "user_id"), "share", places=8)


@register(
    "a14_diversity_grade",
    """SELECT count(DISTINCT category) AS unique_categories,
    CASE WHEN count(DISTINCT category) < 2 THEN 'critical' WHEN count(DISTINCT category) < 5 THEN 'warning' ELSE 'good' END AS grade
    FROM td""",
    [TD_SQL],
)
def a14(spark, sf):
    return reports.diversity_grade(td(spark, sf))


@register(
    "a15_set_report",
    f""", v AS (SELECT *, {CLEAN} AS vendor_cleaned FROM td), n AS (SELECT count(*) AS n FROM td),
    top AS (SELECT vendor_cleaned, count(*) AS c FROM v GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10)
    SELECT 'summary' AS section, 'corrected' AS item, count(*) FILTER (WHERE is_user_corrected) AS n,
           round(avg(CAST(is_user_corrected AS INTEGER)), 6) AS share FROM td
    UNION ALL SELECT 'category', category, count(*), round(count(*) / (SELECT n FROM n), 6) FROM td GROUP BY category
    UNION ALL SELECT 'vendor', vendor_cleaned, c, round(c / (SELECT n FROM n), 6) FROM top""",
    [TD_SQL],
)
def a15(spark, sf):
    from ..functions import text

    rows = td(spark, sf).withColumn("vendor_cleaned", text.clean_vendor(F.col("vendor")))
    return rounded(reports.set_report(rows), "share")


@register(
    "a15_set_summary",
    """SELECT count(*) AS total, min(date) AS first_date, max(date) AS last_date, count(DISTINCT user_id) AS unique_users,
    count(*) FILTER (WHERE is_user_corrected) AS corrected, round(avg(CAST(is_user_corrected AS INTEGER)), 6) AS corrected_share
    FROM td""",
    [TD_SQL],
)
def a15_summary(spark, sf):
    return rounded(reports.set_summary(td(spark, sf)), "corrected_share")


def _outcomes(spark, sf):
    return tx(spark, sf).select(
        "user_id", F.when(F.col("transaction_id").cast("bigint") % 5 == 0, "invalid").otherwise("stored").alias("status")
    )


RUN_SQL = """o AS (SELECT user_id, CAST(transaction_id AS BIGINT) % 5 <> 0 AS stored FROM tx),
run AS (SELECT usr.user_id, count(*) FILTER (WHERE stored) AS stored, count(*) FILTER (WHERE NOT stored) AS failed,
        count(*) FILTER (WHERE stored) > 0 OR count(*) FILTER (WHERE NOT stored) = 0 AS ok
        FROM usr LEFT JOIN o USING (user_id) GROUP BY 1)"""


@register("a16_run_summary", "SELECT * FROM run", [TX_SQL, USR_SQL, RUN_SQL])
def a16(spark, sf):
    return reports.run_summary(_outcomes(spark, sf), usr(spark, sf))


@register(
    "a16_run_totals",
    """SELECT count(*) AS processed_users, count(*) FILTER (WHERE ok) AS users_ok, count(*) FILTER (WHERE NOT ok) AS users_failed,
    CAST(sum(stored) AS BIGINT) AS messages_ok, CAST(sum(failed) AS BIGINT) AS messages_failed FROM run""",
    [TX_SQL, USR_SQL, RUN_SQL],
)
def a16_totals(spark, sf):
    return reports.run_totals(reports.run_summary(_outcomes(spark, sf), usr(spark, sf)))


@register(
    "a17_classification_accuracy",
    """SELECT count(*) AS n, round(avg(CAST(user_category = original_category AS INTEGER)), 6) AS accuracy FROM fb""",
    [FB_SQL],
)
def a17(spark, sf):
    return rounded(reports.classification_accuracy(fb(spark, sf), "user_category", "original_category"), "accuracy")


@register(
    "a17_classification_report",
    """, c AS (SELECT DISTINCT original_category AS class FROM fb UNION SELECT DISTINCT user_category FROM fb),
    s AS (SELECT class, (SELECT count(*) FROM fb WHERE user_category = class) AS support,
          (SELECT count(*) FROM fb WHERE original_category = class) AS called,
          (SELECT count(*) FROM fb WHERE original_category = class AND user_category = class) AS hit FROM c)
    SELECT class, support, round(coalesce(hit / nullif(called, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall,
           round(coalesce(2 * hit / nullif(called + support, 0), 0), 6) AS f1 FROM s""",
    [FB_SQL],
)
def a17_report(spark, sf):
    out = reports.classification_report(fb(spark, sf), "user_category", "original_category")
    return rounded(out, "precision", "recall", "f1")


def _points(spark, sf):
    hourly = reports.hourly_prediction_metrics(pred(spark, sf), AS_OF, hours=24 * 40)
    names = {"predictions": "predictions_per_hour", "avg_confidence": "avg_confidence"}
    points = reports.to_metrics(hourly, names, ["model_version"], F.col("hour"))
    daily = reports.daily_feedback_metrics(fb(spark, sf), AS_OF, days=40)
    more = reports.to_metrics(
        daily, {"feedback_count": "feedback_count", "accuracy": "accuracy"}, ["model_version", "date"],
        F.col("date").cast("timestamp_ntz"),
    )
    per_category = pred(spark, sf).groupBy("category", "model_version", dates.hour_of(F.col("created_at")).alias("hour")).agg(
        F.count("*").alias("n")
    )
    third = reports.to_metrics(per_category, {"n": "category_predictions"}, ["category", "model_version"], F.col("hour"))
    return points.unionByName(more).unionByName(third)


@register(
    "a18_series_alignment",
    """, h AS (SELECT date_trunc('hour', created_at) AS hour, model_version, count(*) AS n, avg(prediction_confidence) AS c FROM pred GROUP BY 1, 2),
    d AS (SELECT CAST(feedback_timestamp AS DATE) AS date, model_version, count(*) AS n,
          round(count(*) FILTER (WHERE original_category = user_category) / count(*), 3) AS a FROM fb GROUP BY 1, 2)
    SELECT 'predictions_per_hour' AS metric, concat('{"model_version":"', model_version, '"}') AS series, hour AS bucket,
           round(CAST(n AS DOUBLE), 6) AS value FROM h
    UNION ALL SELECT 'avg_confidence', concat('{"model_version":"', model_version, '"}'), hour, round(c, 6) FROM h
    UNION ALL SELECT 'feedback_count', concat('{"model_version":"', model_version, '","date":"', CAST(date AS VARCHAR), '"}'),
           CAST(date AS TIMESTAMP), CAST(n AS DOUBLE) FROM d
    UNION ALL SELECT 'accuracy', concat('{"model_version":"', model_version, '","date":"', CAST(date AS VARCHAR), '"}'),
           CAST(date AS TIMESTAMP), round(a, 6) FROM d
    UNION ALL SELECT 'category_predictions', category, date_trunc('hour', created_at), CAST(count(*) AS DOUBLE) FROM pred GROUP BY 2, 3""",
    [PRED_SQL, FB_SQL],
)
def a18(spark, sf):
    return rounded(reports.align_series(_points(spark, sf)), "value")


@register(
    "a19_drift_levels",
    """SELECT transaction_id, CASE WHEN prediction_confidence * 4 >= 1.0 THEN 'RED' WHEN prediction_confidence * 4 >= 0.5 THEN 'YELLOW' ELSE 'GREEN' END AS level
    FROM pred""",
    [PRED_SQL],
)
def a19(spark, sf):
    return pred(spark, sf).select("transaction_id", reports.drift_level(F.col("prediction_confidence") * 4).alias("level"))


@register(
    "k11_metric_points",
    f""", h AS ({HOURLY_SQL})
    SELECT metric, round(value, 6) AS value, model_version, hour AS ts FROM (
      SELECT hour, model_version, CAST(predictions AS DOUBLE) AS predictions_per_hour, avg_confidence,
             CAST(unique_users AS DOUBLE) AS unique_users, CAST(unique_categories AS DOUBLE) AS category_diversity FROM h)
    UNPIVOT (value FOR metric IN (predictions_per_hour, avg_confidence, unique_users, category_diversity))""",
    [PRED_SQL],
)
def k11(spark, sf):
    names = {
        "predictions": "predictions_per_hour", "avg_confidence": "avg_confidence", "unique_users": "unique_users",
        "unique_categories": "category_diversity",
    }
    hourly = reports.hourly_prediction_metrics(pred(spark, sf), AS_OF)
    points = reports.to_metrics(hourly, names, ["model_version"], F.col("hour"))
    return rounded(points, "value").select("metric", "value", F.col("labels")["model_version"].alias("model_version"), "ts")


@register(
    "m5_majority_label",
    f""", v AS (SELECT {CLEAN} AS vendor_cleaned, category, count(*) AS n FROM td GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY vendor_cleaned ORDER BY n DESC, category) AS rn,
          sum(n) OVER (PARTITION BY vendor_cleaned) AS total FROM v)
    SELECT vendor_cleaned, category AS majority, n AS votes, CAST(total AS BIGINT) AS total FROM r WHERE rn = 1""",
    [TD_SQL],
)
def m5(spark, sf):
    from ..functions import text

    return reports.majority_label(td(spark, sf).withColumn("vendor_cleaned", text.clean_vendor(F.col("vendor"))))


REGISTRY_SQL = """reg AS (
  SELECT model_version AS model_id, CAST(split_part(model_version, '_v', 2) AS INTEGER) AS version, 'testing' AS status,
         20 AS traffic_percentage, min(feedback_timestamp) AS created_at,
         concat('models/', model_version) AS path FROM fb GROUP BY 1)"""


def registry(spark, sf):
    from ..functions import text

    return fb(spark, sf).groupBy(F.col("model_version").alias("model_id")).agg(
        F.min("feedback_timestamp").alias("created_at")
    ).select(
        "model_id",
        text.model_number(F.col("model_id")).alias("version"),
        F.lit("testing").alias("status"),
        F.lit(20).alias("traffic_percentage"),
        "created_at",
        F.lit(None).cast("timestamp_ntz").alias("promoted_at"),
        F.concat(F.lit("models/"), "model_id").alias("path"),
    )


@register(
    "w4_latest_model",
    "SELECT model_id, version, path FROM reg ORDER BY version DESC LIMIT 1",
    [FB_SQL, REGISTRY_SQL],
)
def w4(spark, sf):
    return reports.current_model(registry(spark, sf)).select("model_id", "version", "path")


@register("p15_next_version", "SELECT max(version) + 1 AS next_version FROM reg", [FB_SQL, REGISTRY_SQL])
def p15(spark, sf):
    return reports.next_version(registry(spark, sf))


@register(
    "m9_registry_promotion",
    f""", two AS (SELECT * FROM perf ORDER BY number DESC LIMIT 2),
    decision AS (SELECT max(accuracy) FILTER (WHERE number = 10) > max(accuracy) FILTER (WHERE number = 9) * 0.5 AS up FROM two)
    SELECT model_id, version, CASE WHEN up AND version = 10 THEN 'production' ELSE status END AS status,
    CASE WHEN up AND version = 10 THEN 100 ELSE traffic_percentage END AS traffic_percentage,
    CASE WHEN up AND version = 10 THEN {NOW} END AS promoted_at FROM reg, decision""",
    [FB_SQL, REGISTRY_SQL, PERF_SQL],
)
def m9(spark, sf):
    decision = reports.promotion_decision(fb(spark, sf), AS_OF, gain=0.5)
    return reports.promote(registry(spark, sf), decision, AS_OF).select(
        "model_id", "version", "status", "traffic_percentage", "promoted_at"
    )
