"""Registered joins, corrections, upserts, sampling and sinks."""

from pyspark.sql import functions as F

from ..operators import common, extraction, labels, ledger, rules, sampling
from ..session import work_path
from ..sources import readers, writers
from .registry import register
from .views import CODES_SQL, AS_OF, FB_SQL, TD_SQL, TX_SQL, USR_SQL, fb, td, tx, usr

NOW = f"TIMESTAMP '{AS_OF}'"
ID = "CAST(transaction_id AS BIGINT)"
CLEAN = "trim(regexp_replace(lower(vendor), '[^a-z]+', ' ', 'g'))"


def _id():
    return F.col("transaction_id").cast("bigint")


# ------------------------------------------------------------------------------------------------- joins

JOIN_SQL = """SELECT td.transaction_id, td.user_id, vendor, amount, account, template_used,
    day(date) AS day, month(date) AS month, year(date) AS year, dayname(date) AS day_name,
    coalesce(f.user_category, category) AS category, subcategory, f.feedback_id IS NOT NULL AS is_user_corrected, td.model_version, date
    FROM td LEFT JOIN {feedback} f ON td.transaction_id = f.transaction_id AND td.user_id = f.user_id
    WHERE CAST(date AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'"""


@register(
    "j1_training_with_feedback",
    JOIN_SQL.format(feedback="(SELECT * FROM fb WHERE CAST(feedback_timestamp AS DATE) <= DATE '2024-01-28')")
    + " AND coalesce(f.user_category, category) <> 'Uncategorized'",
    [TD_SQL, FB_SQL],
)
def j1(spark, sf):
    return labels.with_feedback(td(spark, sf), fb(spark, sf), "1995-01-01", "2001-12-31", feedback_until="2024-01-28")


@register(
    "j1_training_with_latest_feedback",
    JOIN_SQL.format(
        feedback="""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id, user_id
        ORDER BY feedback_timestamp DESC, feedback_id DESC) AS rn FROM fb) WHERE rn = 1)"""
    )
    + " AND coalesce(f.user_category, category) <> 'Uncategorized'",
    [TD_SQL, FB_SQL],
)
def j1_latest(spark, sf):
    return labels.with_feedback(td(spark, sf), fb(spark, sf), "1995-01-01", "2001-12-31", mode="latest")


@register("j2_training_with_all_rows", JOIN_SQL.format(feedback="fb"), [TD_SQL, FB_SQL])
def j2(spark, sf):
    return labels.with_feedback(td(spark, sf), fb(spark, sf), "1995-01-01", "2001-12-31", only_categorized=False)


@register("k5_replaced_feedback_table", JOIN_SQL.format(feedback="fb"), [TD_SQL, FB_SQL])
def k5(spark, sf):
    path = work_path(spark, "k5")
    writers.replace_table(td(spark, sf), path)
    rows = labels.with_feedback(
        td(spark, sf), fb(spark, sf), "1995-01-01", "2001-12-31", only_categorized=False, ordered=False
    )
    writers.replace_table(rows, path)
    return spark.read.parquet(path)


@register(
    "o1_corrected_first",
    """, j AS (SELECT td.transaction_id, date, f.feedback_id IS NOT NULL AS is_user_corrected, f.feedback_id
      FROM td LEFT JOIN fb f ON td.transaction_id = f.transaction_id AND td.user_id = f.user_id)
    SELECT transaction_id, date, is_user_corrected, row_number() OVER (ORDER BY is_user_corrected DESC, date DESC, transaction_id) AS place FROM j""",
    [TD_SQL, FB_SQL],
)
def o1(spark, sf):
    rows = labels.with_feedback(td(spark, sf), fb(spark, sf), "1995-01-01", "2001-12-31", only_categorized=False)
    return common.numbered(rows.select("transaction_id", "date", "is_user_corrected"), "place")


@register(
    "j5_enabled_users_semi_join",
    "SELECT transaction_id, user_id FROM tx WHERE user_id IN (SELECT user_id FROM usr WHERE email_sync_enabled AND email IS NOT NULL)",
    [TX_SQL, USR_SQL],
)
def j5(spark, sf):
    return labels.synced_ledger(tx(spark, sf), usr(spark, sf)).select("transaction_id", "user_id")


@register(
    "b2_export_rows",
    """SELECT transaction_id, user_id, vendor, account, template_used, date, amount, model_version, prediction_confidence,
    category, subcategory, is_user_corrected, last_modified AS updated_at FROM td
    WHERE date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-01-01' AND user_id IN (SELECT user_id FROM usr WHERE email_sync_enabled)""",
    [TD_SQL, USR_SQL],
)
def b2_export(spark, sf):
    return labels.export_rows(tx(spark, sf), usr(spark, sf), "1996-01-01", "2000-01-01")


# ------------------------------------------------------------------------------------------- corrections


def _corrections(spark, sf):
    return fb(spark, sf).select(
        "transaction_id",
        "user_id",
        F.col("user_category").alias("new_category"),
        F.when(F.col("feedback_id").cast("bigint") % 2 == 0, "sub").alias("new_subcategory"),
        F.when(F.col("feedback_id").cast("bigint") % 5 == 0, "NEW VENDOR").alias("new_vendor"),
        F.col("feedback_timestamp").alias("corrected_at"),
    )


CORRECTION_SQL = """c AS (SELECT transaction_id, user_id, user_category AS new_category, CASE WHEN CAST(feedback_id AS BIGINT) % 2 = 0 THEN 'sub' END AS new_subcategory,
  CASE WHEN CAST(feedback_id AS BIGINT) % 5 = 0 THEN 'NEW VENDOR' END AS new_vendor, feedback_timestamp AS corrected_at,
  row_number() OVER (PARTITION BY transaction_id, user_id ORDER BY feedback_timestamp DESC, user_category DESC) AS rn FROM fb),
corrected AS (SELECT tx.transaction_id, tx.user_id, coalesce(new_category, user_category) AS user_category, coalesce(new_subcategory, user_subcategory) AS user_subcategory,
  coalesce(new_vendor, user_vendor) AS user_vendor, new_category IS NOT NULL OR user_corrected AS user_corrected, corrected_at AS feedback_timestamp,
  CASE WHEN new_category IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE last_modified END AS last_modified, predicted_category
  FROM tx LEFT JOIN (SELECT * FROM c WHERE rn = 1) n ON tx.transaction_id = n.transaction_id AND tx.user_id = n.user_id)"""


@register(
    "j7_corrections",
    "SELECT transaction_id, user_category, user_subcategory, user_vendor, user_corrected, feedback_timestamp, last_modified FROM corrected",
    [TX_SQL, FB_SQL, CORRECTION_SQL],
)
def j7(spark, sf):
    return labels.apply_corrections(tx(spark, sf), _corrections(spark, sf), AS_OF).select(
        "transaction_id", "user_category", "user_subcategory", "user_vendor", "user_corrected", "feedback_timestamp", "last_modified"
    )


@register(
    "j8_feedback_flags",
    """SELECT tx.transaction_id, f.at IS NOT NULL OR user_corrected AS user_corrected, f.at AS feedback_timestamp
    FROM tx LEFT JOIN (SELECT transaction_id, user_id, max(feedback_timestamp) AS at FROM fb GROUP BY 1, 2) f
    ON tx.transaction_id = f.transaction_id AND tx.user_id = f.user_id""",
    [TX_SQL, FB_SQL],
)
def j8(spark, sf):
    return labels.mark_feedback(tx(spark, sf), fb(spark, sf)).select("transaction_id", "user_corrected", "feedback_timestamp")


FEEDBACK_ROWS_SQL = """SELECT concat(tx.transaction_id, '_', CAST(epoch_us(corrected_at) AS VARCHAR)) AS feedback_id, tx.transaction_id, tx.user_id,
    predicted_category AS original_category, predicted_subcategory AS original_subcategory, new_category AS user_category,
    new_subcategory AS user_subcategory, prediction_confidence, model_version, vendor, amount,
    corrected_at AS feedback_timestamp, date AS transaction_date
    FROM c JOIN tx ON tx.transaction_id = c.transaction_id AND tx.user_id = c.user_id WHERE predicted_category <> new_category"""


@register("k6_feedback_rows", FEEDBACK_ROWS_SQL, [TX_SQL, FB_SQL, CORRECTION_SQL])
def k6(spark, sf):
    path = work_path(spark, "k6")
    rows = labels.feedback_rows(tx(spark, sf), _corrections(spark, sf))
    even = F.col("transaction_id").cast("bigint") % 2 == 0
    writers.append_rows(rows.filter(even), path)
    writers.append_rows(rows.filter(~even), path)
    return spark.read.parquet(path).drop("vendor_cleaned", "template_used")


@register(
    "b5_correct",
    """SELECT user_id, coalesce(user_category, predicted_category, 'Uncategorized') AS category, count(*) AS transaction_count,
    max(last_modified) AS last_used FROM corrected GROUP BY 1, 2""",
    [TX_SQL, FB_SQL, CORRECTION_SQL],
)
def b5(spark, sf):
    from . import jobs

    return jobs.correct(tx(spark, sf), _corrections(spark, sf), AS_OF).categories


# ----------------------------------------------------------------------------------------------- upserts


def _ledger_and_batch(spark, sf):
    """A ledger of the rows that are not multiples of 4, and a batch of the multiples of 3 sent twice."""
    base = tx(spark, sf).withColumns(
        {"created_at": F.col("date"), "status": F.lit("processed"), "notes": F.concat(F.lit("n"), F.col("transaction_id"))}
    )
    old = base.filter(_id() % 4 != 0)
    resent = base.filter(_id() % 3 == 0).drop("notes", "created_at", "status")
    first = resent.withColumns({"amount": F.lit(1.0), "seq": F.lit(1)})
    second = resent.withColumns(
        {"amount": F.col("amount") + 1, "vendor": F.when(_id() % 2 == 0, F.concat(F.lit("X "), "vendor")), "seq": F.lit(2)}
    )
    return old, first.unionByName(second)


UPSERT_SQL = f"""SELECT transaction_id, user_id, CASE WHEN {ID} % 3 = 0 THEN amount + 1 ELSE amount END AS amount,
    CASE WHEN {ID} % 6 = 0 THEN concat('X ', vendor) WHEN {ID} % 12 IN (3, 9) OR {ID} % 3 <> 0 THEN vendor END AS vendor,
    CASE WHEN {ID} % 4 <> 0 THEN concat('n', transaction_id) END AS notes,
    CASE WHEN {ID} % 4 <> 0 THEN date ELSE {NOW} END AS created_at, CASE WHEN {ID} % 3 = 0 THEN {NOW} ELSE last_modified END AS last_modified,
    user_category, 'processed' AS status FROM tx WHERE {ID} % 4 <> 0 OR {ID} % 3 = 0"""
UPSERT_COLUMNS = ["transaction_id", "user_id", "amount", "vendor", "notes", "created_at", "last_modified", "user_category", "status"]


@register("j3_upsert", UPSERT_SQL, [TX_SQL])
def j3(spark, sf):
    old, batch = _ledger_and_batch(spark, sf)
    return ledger.upsert(old, batch, AS_OF, order=["seq"]).select(*UPSERT_COLUMNS)


@register("k7_upsert_snapshots", UPSERT_SQL, [TX_SQL])
def k7(spark, sf):
    """Snapshot, upsert, snapshot, the same upsert again."""
    old, batch = _ledger_and_batch(spark, sf)
    path = work_path(spark, "k7")
    current = writers.write_snapshot(old, path, "0")
    for run in ("1", "2"):
        current = writers.write_snapshot(ledger.upsert(spark.read.parquet(current), batch, AS_OF, order=["seq"]), path, run)
    return spark.read.parquet(current).select(*UPSERT_COLUMNS)


@register("k7_upsert_touched_partitions", UPSERT_SQL, [TX_SQL])
def k7_table(spark, sf):
    """The changes one after the other into a partitioned table."""
    old, batch = _ledger_and_batch(spark, sf)
    path = work_path(spark, "k7-table")
    ledger.create_table(old, path, 16)
    for seq in (1, 2):
        ledger.upsert_table(path, batch.filter(F.col("seq") == seq), AS_OF, ["seq"], 16)
    return ledger.read_table(spark, path).select(*UPSERT_COLUMNS)


@register(
    "k8_patched_rows",
    f"""SELECT transaction_id, CASE WHEN {ID} % 5 = 0 THEN 'patched' ELSE vendor END AS vendor, amount,
    CASE WHEN {ID} % 5 = 0 THEN {NOW} ELSE last_modified END AS last_modified FROM tx""",
    [TX_SQL],
)
def k8(spark, sf):
    rows = tx(spark, sf)
    updates = rows.filter(_id() % 5 == 0).select("user_id", "transaction_id", F.lit("patched").alias("vendor"))
    return ledger.patch(rows, updates, AS_OF).select("transaction_id", "vendor", "amount", "last_modified")


@register(
    "k7_ledger_layout",
    f"""SELECT CASE WHEN {ID} % 5 <> 0 THEN transaction_id ELSE concat('api-', transaction_id) END AS transaction_id, user_id,
    {CLEAN} AS vendor_cleaned, amount, date, day(date) AS day, dayname(date) AS day_name, predicted_category,
    coalesce(predicted_subcategory, 'Uncategorized') AS predicted_subcategory
    FROM tx WHERE {ID} % 10 <> 0 AND {ID} % 7 <> 0 AND {ID} % 9 <> 0 AND {ID} % 8 <> 0""",
    [TX_SQL],
)
def k7_layout(spark, sf):
    from .checks_rules import _gated

    good, _ = ledger.split_writable(_gated(spark, sf))
    return ledger.ledger_rows(good, AS_OF).select(
        "transaction_id", "user_id", "vendor_cleaned", "amount", "date", "day", "day_name", "predicted_category", "predicted_subcategory"
    )


# ------------------------------------------------------------------------------------------------- sinks


@register("k1_partitioned_table", "SELECT transaction_id, user_id, category, date, amount FROM td", [TD_SQL])
def k1(spark, sf):
    path = work_path(spark, "k1")
    writers.write_training_table(td(spark, sf), path)
    return writers.read_training_table(spark, path).select("transaction_id", "user_id", "category", "date", "amount")


APPEND_SQL = f"""SELECT transaction_id, user_id, amount, CASE WHEN {ID} % 2 = 1 THEN category END AS category FROM td
    WHERE {ID} % 6 <> 0 UNION ALL SELECT transaction_id, user_id, amount, NULL FROM td WHERE {ID} % 6 = 0"""


@register("k2_append_with_new_column", APPEND_SQL, [TD_SQL])
def k2(spark, sf):
    path = work_path(spark, "k2")
    rows = td(spark, sf).select("transaction_id", "user_id", "amount", "category")
    writers.append_rows(rows.filter(_id() % 2 == 0).drop("category"), path)
    writers.append_rows(rows.filter(_id() % 2 == 1), path)
    return spark.read.option("mergeSchema", "true").parquet(path)


@register("s8_merged_training_parts", APPEND_SQL, [TD_SQL])
def s8(spark, sf):
    path = work_path(spark, "s8")
    rows = td(spark, sf).select("transaction_id", "user_id", "amount", "category")
    writers.append_rows(rows.filter(_id() % 2 == 0).drop("category"), path)
    writers.append_rows(rows.filter(_id() % 2 == 1), path)
    return readers.read_training_parts(spark, path)


@register(
    "k2_newest_export",
    "SELECT transaction_id, user_id, category, last_modified AS updated_at FROM td",
    [TD_SQL],
)
def k2_newest(spark, sf):
    rows = td(spark, sf).select("transaction_id", "user_id", "category", F.col("last_modified").alias("updated_at"))
    older = rows.withColumns({"category": F.lit("old"), "updated_at": F.col("updated_at") - F.expr("INTERVAL '7' DAY")})
    return labels.newest_export(rows.unionByName(older))


@register("k3_training_files", "SELECT count(*) AS n, true AS within_limit FROM td", [TD_SQL])
def k3(spark, sf):
    path = work_path(spark, "k3")
    writers.write_training_files(td(spark, sf), path, rows_per_file=10_000)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    return per_file.agg(F.sum("rows").alias("n"), (F.max("rows") <= 10_000).alias("within_limit"))


@register("k4_snapshot", "SELECT transaction_id, category, subcategory FROM td", [TD_SQL])
def k4(spark, sf):
    target = writers.write_snapshot(td(spark, sf), work_path(spark, "k4"), "20240131")
    return spark.read.parquet(target).select("transaction_id", "category", "subcategory")


@register(
    "s9_training_csv",
    f"""SELECT transaction_id, vendor, coalesce(nullif({CLEAN}, ''), 'unknown') AS vendor_cleaned, amount,
    CASE WHEN {ID} % 3 = 0 THEN 'unknown' ELSE account END AS account, day(date) AS day, dayname(date) AS day_name, category, is_user_corrected,
    coalesce(nullif(one, ''), 'unknown') AS cleaned_metaphone FROM td LEFT JOIN codes ON {CLEAN} = cleaned""",
    [TD_SQL, CODES_SQL],
)
def s9(spark, sf):
    path = work_path(spark, "s9")
    columns = ["transaction_id", "user_id", "vendor", "amount", "account", "template_used", "date", "category", "subcategory", "is_user_corrected"]
    rows = td(spark, sf).withColumn("account", F.when(_id() % 3 != 0, F.col("account"))).select(*columns)
    rows.write.option("header", "true").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)
    return readers.read_training_csv(spark, path).select(
        "transaction_id", "vendor", "vendor_cleaned", "amount", "account", "day", "day_name", "category", "is_user_corrected", "cleaned_metaphone"
    )


# ---------------------------------------------------------------------------------- sampling and splitting

BALANCE_SQL = """c AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE is_user_corrected) AS kept FROM td GROUP BY 1),
cap AS (SELECT CAST(floor(min(n) * {ratio}) AS BIGINT) AS cap FROM c),
r AS (SELECT td.*, c.n, c.kept, cap.cap, row_number() OVER (PARTITION BY td.category, is_user_corrected ORDER BY md5(concat(transaction_id, '-42')), transaction_id) AS rn
  FROM td JOIN c ON td.category = c.category, cap),
balanced AS (SELECT * FROM r WHERE n <= cap OR is_user_corrected OR rn <= greatest(cap - kept, 0))"""


@register(
    "w1_balanced_categories",
    "SELECT transaction_id, category, is_user_corrected FROM balanced",
    [TD_SQL, BALANCE_SQL.format(ratio="1.3")],
)
def w1(spark, sf):
    return sampling.balance_categories(td(spark, sf), 1.3).select("transaction_id", "category", "is_user_corrected")


@register(
    "w2_time_split",
    """, n AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS cut FROM td)
    SELECT transaction_id, row_number() OVER (ORDER BY date, md5(concat(transaction_id, '-42')), transaction_id) <= (SELECT cut FROM n) AS is_train FROM td""",
    [TD_SQL],
)
def w2(spark, sf):
    return sampling.split_by_time(td(spark, sf)).select("transaction_id", "is_train")


@register(
    "w2_time_split_hot_day",
    f""", h AS (SELECT transaction_id, CASE WHEN {ID} % 3 <> 0 THEN TIMESTAMP '1998-01-01' ELSE date END AS date FROM td),
    n AS (SELECT CAST(floor(count(*) * 0.6) AS BIGINT) AS cut FROM h)
    SELECT transaction_id, row_number() OVER (ORDER BY date, md5(concat(transaction_id, '-42')), transaction_id) <= (SELECT cut FROM n) AS is_train FROM h""",
    [TD_SQL],
)
def w2_hot(spark, sf):
    hot = F.when(_id() % 3 != 0, F.lit("1998-01-01").cast("timestamp_ntz")).otherwise(F.col("date"))
    return sampling.split_by_time(td(spark, sf).withColumn("date", hot), 0.6).select("transaction_id", "is_train")


@register(
    "w3_sample_weights",
    "SELECT transaction_id, CASE WHEN is_user_corrected THEN 3.0 ELSE 1.0 END AS sample_weight FROM td",
    [TD_SQL],
)
def w3(spark, sf):
    return sampling.with_weights(td(spark, sf)).select("transaction_id", "sample_weight")


@register(
    "m8_challenger_share",
    """SELECT transaction_id, CAST(concat('0x', substr(md5(concat(transaction_id, '-42')), 1, 8)) AS BIGINT) % 100 < 20 AS is_challenger FROM td""",
    [TD_SQL],
)
def m8(spark, sf):
    return sampling.assign_challenger(td(spark, sf)).select("transaction_id", "is_challenger")


# --------------------------------------------------------------------------------------------- set operators


@register(
    "u1_union_by_name",
    f"SELECT transaction_id, user_id, CASE WHEN {ID} % 2 = 1 THEN category END AS category FROM td",
    [TD_SQL],
)
def u1(spark, sf):
    rows = td(spark, sf).select("transaction_id", "user_id", "category")
    return rows.filter(_id() % 2 == 1).unionByName(rows.filter(_id() % 2 == 0).drop("category"), allowMissingColumns=True)


@register(
    "u2_keyed_union_new_wins",
    f"""SELECT transaction_id, CASE WHEN {ID} % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM tx WHERE {ID} % 3 = 0 OR {ID} % 2 = 0""",
    [TX_SQL],
)
def u2(spark, sf):
    rows = tx(spark, sf).select("transaction_id")
    old = rows.filter(_id() % 2 == 0).withColumn("origin", F.lit("old"))
    new = rows.filter(_id() % 3 == 0).withColumn("origin", F.lit("new"))
    return extraction.merge_samples(old, new, "transaction_id")


@register(
    "u3_set_difference",
    "SELECT DISTINCT vendor FROM tx EXCEPT SELECT vendor FROM tx WHERE amount > 450000 AND CAST(transaction_id AS BIGINT) % 24 < 5",
    [TX_SQL],
)
def u3(spark, sf):
    rows = tx(spark, sf)
    high = rows.filter((F.col("amount") > 450000) & (_id() % 24 < 5))
    return rows.select("vendor").distinct().join(high.select("vendor").distinct(), "vendor", "left_anti")


@register(
    "k2_latest_row_per_user",
    """SELECT user_id, transaction_id, date FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, transaction_id DESC) AS rn FROM tx) WHERE rn = 1""",
    [TX_SQL],
)
def latest(spark, sf):
    return common.latest_by(tx(spark, sf).select("user_id", "transaction_id", "date"), ["user_id"], ["date", "transaction_id"])


@register(
    "b3_prepared_training_rows",
    f"""SELECT transaction_id, user_id, coalesce(user_vendor, vendor) AS vendor,
    trim(regexp_replace(lower(coalesce(user_vendor, vendor)), '[^a-z]+', ' ', 'g')) AS vendor_cleaned, amount, account, template_used, date,
    day(date) AS day, month(date) AS month, year(date) AS year, dayname(date) AS day_name, category, subcategory,
    user_category IS NOT NULL OR user_subcategory IS NOT NULL AS is_user_corrected, user_category, user_subcategory, predicted_category, predicted_subcategory,
    one AS cleaned_metaphone
    FROM td LEFT JOIN codes ON trim(regexp_replace(lower(coalesce(user_vendor, vendor)), '[^a-z]+', ' ', 'g')) = cleaned""",
    [TD_SQL, CODES_SQL],
)
def b3(spark, sf):
    from . import jobs

    return jobs.prepare_training(tx(spark, sf))


@register("f5_required_columns", "SELECT transaction_id, amount FROM td", [TD_SQL])
def f5(spark, sf):
    checked = common.require_columns(td(spark, sf), ["vendor", "amount", "account", "date", "category", "subcategory"])
    return checked.select("transaction_id", "amount")


@register(
    "j6_scored_in_place",
    "SELECT transaction_id, 'Uncategorized' AS predicted_category FROM tx",
    [TX_SQL],
)
def j6(spark, sf):
    blank = tx(spark, sf).withColumns(rules.default_prediction())
    return rules.apply_prediction(blank).select("transaction_id", "predicted_category")
