"""Registered model steps and whole jobs."""

import datetime

from pyspark.sql import functions as F

from ..operators import model, reports, sampling
from ..operators.common import spread
from ..operators.ledger_table import LedgerTable
from ..sources import writers
from ..session import work_path
from . import jobs
from .. import schemas
from .checks_reports import CLEAN, DRIFT_SQL, REGISTRY_SQL
from .checks_rules import ID
from .registry import register, rounded
from .views import AS_OF, FB_SQL, PRED_SQL, TD_SQL, TX_SQL, USR_SQL, fb, pred, td, tx, usr

NOW = f"TIMESTAMP '{AS_OF}'"

FULL = model.Settings(as_of=AS_OF)

# Small trees for tests that fit several models.
SMALL = model.Settings(
    trees=8, depth=6, as_of=AS_OF,
    sizes={"vendor": 256, "vendor_cleaned": 256, "cleaned_metaphone": 256, "template_used": 128, "account": 256, "day": 64,
           "month": 32, "year": 64, "day_name": 32},
)


def _labelled(spark, sf):
    """Training rows with a label that follows the vendor, apart from one row in ten."""
    rows = td(spark, sf)
    key = F.col("transaction_id").cast("bigint")
    label = F.when(key % 10 == 3, F.col("category")).otherwise(F.concat(F.lit("kind "), F.substring("vendor", 1, 3)))
    return rows.withColumns({"category": label, "subcategory": F.concat(F.lit("sub "), F.substring("vendor", 1, 1))})


def _trained(spark, sf):
    rows = sampling.split_by_time(sampling.with_weights(_labelled(spark, sf)))
    return model.fit(rows.filter("is_train"), rows.filter("NOT is_train"), FULL)


@register("m1_feature_vectors", "SELECT transaction_id, true AS unit_blocks FROM td", [TD_SQL])
def m1(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = model.feature_frame(td(spark, sf), FULL)
    vectors = model.fit_features(rows, FULL).transform(rows)
    block = vector_to_array("template_used_unit")
    norm = F.aggregate(F.transform(block, lambda x: x * x), F.lit(0.0), lambda a, b: a + b)
    return vectors.select("transaction_id", (F.abs(norm - 1) < 1e-9).alias("unit_blocks"))


@register("m2_trained_accuracy", "SELECT unnest(['category', 'subcategory']) AS target, true AS beats_largest_class")
def m2(spark, sf):
    trained = _trained(spark, sf)
    rows = trained.predictions
    shares = [rows.groupBy(t).count().agg((F.max("count") / F.sum("count")).alias("share")).select(F.lit(t).alias("target"), "share") for t in model.TARGETS]
    return trained.accuracy().join(shares[0].unionByName(shares[1]), "target").select("target", (F.col("accuracy") > F.col("share")).alias("beats_largest_class"))


@register(
    "m3_scored_rows",
    "SELECT transaction_id, true AS has_labels, true AS confidence_fits, 'model' AS source, 'transaction_model_v1' AS model_version FROM td",
    [TD_SQL],
)
def m3(spark, sf):
    trained = _trained(spark, sf)
    scored = model.score(trained.model, spread(_labelled(spark, sf)), "transaction_model_v1", FULL)
    labels = F.col("category").isNotNull() & F.col("subcategory").isNotNull()
    fits = (F.col("confidence") > 0) & (F.col("confidence") <= 1)
    return scored.select("transaction_id", labels.alias("has_labels"), fits.alias("confidence_fits"), "source", "model_version")


@register(
    "m4_scored_ingest",
    f"""SELECT transaction_id, user_id, {CLEAN} AS vendor_cleaned, date, true AS has_category, 'transaction_model_v1' AS model_version FROM tx
    WHERE {ID} // 8 NOT IN (SELECT {ID} // 8 FROM tx WHERE {ID} % 801 = 0 OR {ID} % 101 = 0 OR {ID} % 103 = 0)""",
    [TX_SQL],
)
def m4(spark, sf):
    """Requests through the gate, scored and merged into an empty ledger."""
    from .checks_rules import _requests

    trained = _trained(spark, sf)
    empty = spark.createDataFrame([], schemas.struct(schemas.TRANSACTION_DDL))
    loaded = jobs.ingest(_requests(spark, sf), empty, lambda rows: model.score(trained.model, rows, "transaction_model_v1", FULL), AS_OF)
    has_category = F.col("predicted_category").isNotNull().alias("has_category")
    return loaded.ledger.select("transaction_id", "user_id", "vendor_cleaned", "date", has_category, "model_version")


@register(
    "m4_stored_ingest",
    f""", bad AS (SELECT DISTINCT {ID} // 8 AS request FROM tx WHERE {ID} % 801 = 0 OR {ID} % 101 = 0 OR {ID} % 103 = 0),
    r AS (SELECT *, {ID} // 8 NOT IN (SELECT request FROM bad) AS ok, {ID} % 2 = 0 AS known FROM tx)
    SELECT transaction_id, user_id, ok AS scored, CASE WHEN ok THEN 'transaction_model_v1' ELSE 'before' END AS model_version,
      CASE WHEN known THEN 'kept' END AS notes, CASE WHEN known THEN date ELSE {NOW} END AS created_at, CASE WHEN ok THEN {NOW} ELSE date END AS last_modified
    FROM r WHERE ok OR known""",
    [TX_SQL],
)
def m4_stored(spark, sf):
    """Requests through the gate, scored and merged into a stored ledger that knows every other row under another label."""
    from .checks_rules import _requests

    known = tx(spark, sf).filter(F.col("transaction_id").cast("bigint") % 2 == 0)
    known = known.withColumns({c: F.lit("before") for c in ("predicted_category", "predicted_subcategory", "model_version")})
    known = known.withColumns({"notes": F.lit("kept"), "created_at": F.col("date"), "status": F.lit("processed")})
    table = LedgerTable.create(known, work_path(spark, "m4-ledger"), buckets=8)
    trained = _trained(spark, sf)
    loaded = jobs.ingest(_requests(spark, sf), table, lambda rows: model.score(trained.model, rows, "transaction_model_v1", FULL), AS_OF)
    scored = (F.col("predicted_category") != "before").alias("scored")
    return loaded.ledger.select("transaction_id", "user_id", scored, "model_version", "notes", "created_at", "last_modified")


@register(
    "m6_retrained_registry",
    """SELECT model_id, version, status, traffic_percentage FROM reg
    UNION ALL SELECT concat('transaction_model_v', CAST(max(version) + 1 AS VARCHAR)), max(version) + 1, 'testing', 20 FROM reg""",
    [FB_SQL, REGISTRY_SQL],
)
def m6(spark, sf):
    from .checks_reports import registry

    path = work_path(spark, "m6")
    known = registry(spark, sf).withColumn("updated_at", F.col("created_at"))
    known.write.parquet(f"{path}/registry")
    jobs.retrain(spark, _labelled(spark, sf), fb(spark, sf), f"{path}/registry", f"{path}/models", AS_OF, settings=FULL)
    return spark.read.parquet(f"{path}/registry").select("model_id", "version", "status", "traffic_percentage")


@register(
    "m10_distinct_scoring_keys",
    """SELECT count(*) AS n, count(category) AS scored, count(DISTINCT lower(concat_ws('|', vendor, CAST(amount AS VARCHAR), template_used))) AS keys FROM td""",
    [TD_SQL],
)
def m10(spark, sf):
    from ..functions import text

    trained = _trained(spark, sf)
    scored = model.score_distinct(trained.model, _labelled(spark, sf), "transaction_model_v1", FULL)
    key = text.score_key(F.col("vendor"), F.lit(None).cast("string"), F.col("amount"), F.col("template_used"))
    return scored.agg(F.count("*").alias("n"), F.count("category").alias("scored"), F.count_distinct(key).alias("keys"))


@register("b4_trained_report")
def b4(spark, sf):
    return jobs.train(_labelled(spark, sf), FULL).report("category")


B2_SQL = """, latest AS (SELECT td.*, row_number() OVER (PARTITION BY transaction_id ORDER BY date) AS rn FROM td)
    SELECT l.transaction_id, l.user_id, l.date, coalesce(f.user_category, category) AS category, f.feedback_id IS NOT NULL AS is_user_corrected
    FROM latest l LEFT JOIN fb f ON l.transaction_id = f.transaction_id AND l.user_id = f.user_id
    WHERE rn = 1 AND l.user_id IN (SELECT user_id FROM usr WHERE email_sync_enabled) AND coalesce(f.user_category, category) <> 'Uncategorized'
      AND date >= TIMESTAMP '2001-08-02' - INTERVAL 180 DAY"""


@register("b2_export_job", B2_SQL, [TD_SQL, FB_SQL, USR_SQL])
def b2(spark, sf):
    """Exported twice, as the weekly job does; the overlap is removed on reading."""
    path = work_path(spark, "b2")
    for _ in range(2):
        out = jobs.export_training(
            tx(spark, sf), usr(spark, sf), fb(spark, sf), f"{path}/table", f"{path}/files", "2001-08-02 00:00:00"
        )
    return out.select("transaction_id", "user_id", "date", "category", "is_user_corrected")


@register("b2_export_all", B2_SQL.replace("SELECT l.transaction_id,", "SELECT DATE '2001-08-02' AS export_day, l.transaction_id,"), [TD_SQL, FB_SQL, USR_SQL])
def b2_all(spark, sf):
    """The full action on two days; the files of the first are too old by the second."""
    path = work_path(spark, "b2-all")
    for as_of in ("2001-06-01 00:00:00", "2001-08-02 00:00:00"):
        jobs.export_all(tx(spark, sf), usr(spark, sf), fb(spark, sf), f"{path}/table", f"{path}/files", as_of)
    return spark.read.parquet(f"{path}/files").select("transaction_id", "user_id", "date", "category", "is_user_corrected", "export_day")


@register(
    "b2_export_incremental",
    """SELECT transaction_id, user_id, date, category FROM td
    WHERE user_id IN (SELECT user_id FROM usr WHERE email_sync_enabled) AND date BETWEEN TIMESTAMP '2001-08-02' - INTERVAL 7 DAY AND TIMESTAMP '2001-08-02'""",
    [TD_SQL, USR_SQL],
)
def b2_incremental(spark, sf):
    """The weekly action twice; the table's overlapping rows are removed on reading."""
    from ..operators import labels

    path = work_path(spark, "b2-week")
    for _ in range(2):
        jobs.export_incremental(tx(spark, sf), usr(spark, sf), path, "2001-08-02 00:00:00")
    return labels.newest_export(writers.read_training_table(spark, path)).select("transaction_id", "user_id", "date", "category")


@register(
    "b2_daily_stats",
    """SELECT count(*) AS total_records, true AS users_fit, true AS categories_fit, count(*) FILTER (WHERE is_user_corrected) AS user_corrected_count,
    min(date) AS earliest_date, max(date) AS latest_date, count(DISTINCT category) AS unique_categories FROM td""",
    [TD_SQL],
)
def b2_stats(spark, sf):
    """The statistics action over one row a day, after the last years were counted again. Estimates are held against the exact counts."""
    path, rows = work_path(spark, "b2-stats"), td(spark, sf)
    for years in (rows.filter("date < '2000-01-01'"), rows.filter("date >= '1998-01-01'")):
        jobs.update_daily_stats(spark, years, path)
    exact = reports.training_stats(rows)
    stats = jobs.export_daily_stats(spark, path).withColumns({"_users": exact.select("unique_users").scalar(), "_categories": exact.select("unique_categories").scalar()})
    fits = F.abs(F.col("unique_users") - F.col("_users")) <= F.col("_users") * 0.05
    same = F.col("unique_categories") == F.col("_categories")
    return stats.select("total_records", fits.alias("users_fit"), same.alias("categories_fit"), "user_corrected_count", "earliest_date", "latest_date", "unique_categories")


@register(
    "k10_dropped_days",
    "SELECT feedback_id, feedback_timestamp FROM fb WHERE feedback_timestamp >= TIMESTAMP '2024-01-21'",
    [FB_SQL],
)
def k10_days(spark, sf):
    """A table by day from which the days before the retention are dropped."""
    path = work_path(spark, "k10-days")
    writers.replace_days(fb(spark, sf).select("feedback_id", "feedback_timestamp"), path, "feedback_timestamp")
    writers.drop_days_before(spark, path, "date_day", datetime.date(2024, 1, 21))
    return spark.read.parquet(path).drop("date_day")


@register(
    "b6_monitoring_points",
    f""", h AS (SELECT count(DISTINCT (date_trunc('hour', created_at), model_version)) AS n FROM pred WHERE created_at > {NOW} - INTERVAL 24 HOUR),
    d AS (SELECT count(DISTINCT (CAST(feedback_timestamp AS DATE), model_version)) AS n FROM fb WHERE feedback_timestamp > {NOW} - INTERVAL 7 DAY),
    p AS (SELECT count(*) AS n, floor(sum(c) * 1e6 + 0.5) / 1e6 AS s FROM (SELECT count(*) AS k, avg(prediction_confidence) AS c FROM pred WHERE created_at > {NOW} - INTERVAL 1 DAY
          GROUP BY category, model_version HAVING count(*) > 10))
    SELECT 'predictions_per_hour' AS metric, n FROM h UNION ALL SELECT 'avg_confidence', n FROM h UNION ALL SELECT 'unique_users', n FROM h
    UNION ALL SELECT 'category_diversity', n FROM h UNION ALL SELECT 'feedback_count', n FROM d UNION ALL SELECT 'accuracy', n FROM d
    UNION ALL SELECT 'users_providing_feedback', n FROM d
    UNION ALL SELECT 'category_predictions', n FROM p WHERE n > 0 UNION ALL SELECT 'category_confidence', n FROM p WHERE n > 0
    UNION ALL SELECT * FROM (SELECT 'model_drift_detected' AS metric, count(*) FILTER (WHERE drift_detected) AS n FROM drift) WHERE n > 0""",
    [PRED_SQL, FB_SQL, DRIFT_SQL],
)
def b6(spark, sf):
    return jobs.monitoring_cycle(pred(spark, sf), fb(spark, sf), AS_OF).groupBy("metric").agg(F.count("*").alias("n"))


@register(
    "b7_metrics_report",
    f"""SELECT 'all' AS category, count(*) AS total, floor((1 - count(*) FILTER (WHERE original_category <> user_category) / count(*)) * 1e6 + 0.5) / 1e6 AS accuracy
    FROM fb WHERE feedback_timestamp > {NOW} - INTERVAL 30 DAY
    UNION ALL SELECT original_category, count(*), floor(count(*) FILTER (WHERE original_category = user_category) / count(*) * 1e6 + 0.5) / 1e6
    FROM fb WHERE feedback_timestamp > {NOW} - INTERVAL 30 DAY GROUP BY 1""",
    [FB_SQL],
)
def b7(spark, sf):
    stats, categories = jobs.metrics_report(fb(spark, sf), AS_OF, by_category=True)
    head = stats.select(F.lit("all").alias("category"), F.col("total_feedback").alias("total"), F.col("accuracy_rate").alias("accuracy"))
    return rounded(head.unionByName(categories.select(F.col("original_category").alias("category"), "total", "accuracy")), "accuracy")
