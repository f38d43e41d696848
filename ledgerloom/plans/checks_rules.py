"""Registered scans, row rules and validation."""

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import common, ledger, rules
from ..session import work_path
from ..sources import mailbox, readers
from .registry import register
from .views import CODES_SQL, AS_OF, FB_SQL, PRED_SQL, TD_SQL, TX_SQL, USR_SQL, fb, msg, pred, table, td, tx, usr

NOW = f"TIMESTAMP '{AS_OF}'"
CLEAN = "trim(regexp_replace(lower(vendor), '[^a-z]+', ' ', 'g'))"
ID = "CAST(transaction_id AS BIGINT)"


def _id():
    return F.col("transaction_id").cast("bigint")


# ------------------------------------------------------------------------------------------------- scans


@register(
    "s1_unread_messages",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id FROM orders WHERE o_orderkey % 4 <> 0",
)
def s1(spark, sf):
    return readers.unread_messages(msg(spark, sf), folder="INBOX").select("id", "user_id")


@register(
    "s1_mailbox_pages",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id FROM orders WHERE o_orderkey % 4 <> 0",
)
def s1_pages(spark, sf):
    path = work_path(spark, "s1-pages")
    mailbox.write_pages(msg(spark, sf), path)
    return mailbox.read_mailbox(spark, path, folder="INBOX").select("id", "user_id")


SUBJECTS = [
    "Your TRANSACTION alert", "External Transfer sent", "A payment through Chase", "Withdrawal or Purchase notice",
    "Deposit received", "Early pay: deposit received", "Charge on account ending in 1234", "Monthly statement of transactions",
]
SENDERS = ["alerts@huntington.example.com", "noreply.pncalerts@pnc.com", "bank@example.com"]


@register(
    "s2_search_messages",
    """, m AS (SELECT o_orderkey, o_orderdate AS sent_at,
      ['your transaction alert','external transfer sent','a payment through chase','withdrawal or purchase notice',
       'deposit received','early pay: deposit received','charge on account ending in 1234','monthly statement of transactions'][CAST(o_orderkey % 8 AS INTEGER) + 1] AS s,
      ['alerts@huntington.example.com','noreply.pncalerts@pnc.com','bank@example.com'][CAST(o_orderkey // 8 % 3 AS INTEGER) + 1] AS f FROM orders)
    SELECT CAST(o_orderkey AS VARCHAR) AS id, s AS subject FROM m
    WHERE sent_at >= DATE '1996-01-01' AND sent_at < DATE '1999-01-01' AND s NOT LIKE '%statement%'
      AND (s LIKE '%transaction%' OR s LIKE '%external transfer%' OR s LIKE '%payment through chase%'
        OR (f LIKE '%huntington%' AND s LIKE '%withdrawal or purchase%')
        OR (f LIKE '%huntington%' AND s LIKE '%deposit%' AND s NOT LIKE '%early pay%')
        OR (s LIKE '%account ending in%' AND f NOT LIKE '%noreply.pncalerts@pnc.com%'))""".replace(", m AS", "WITH m AS", 1),
)
def s2(spark, sf):
    key = F.col("o_orderkey")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    mail = table(spark, sf, "orders").select(
        key.cast("string").alias("id"),
        pick(SUBJECTS, key % 8).alias("subject"),
        pick(SENDERS, F.floor(key / 8) % 3).alias("from_addr"),
        F.col("o_orderdate").alias("sent_at"),
    )
    return readers.search_messages(mail, "1996-01-01", "1999-01-01").select("id", F.lower("subject").alias("subject"))


@register(
    "s3_enabled_ledger",
    """SELECT transaction_id, user_id, date, amount FROM tx WHERE date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'
    AND user_id IN (SELECT user_id FROM usr WHERE email_sync_enabled)""",
    [TX_SQL, USR_SQL],
)
def s3(spark, sf):
    from ..operators import labels

    in_range = readers.scan_ledger(tx(spark, sf), start="1997-01-01", end="1999-12-31")
    return labels.enabled_ledger(in_range, usr(spark, sf)).select("transaction_id", "user_id", "date", "amount")


@register(
    "s4_ledger_limit_per_user",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date, transaction_id) AS rn FROM tx
             WHERE date >= TIMESTAMP '1996-01-01' AND date <= TIMESTAMP '2000-12-31')
    SELECT transaction_id, user_id, date FROM r WHERE rn <= 3""",
    [TX_SQL],
)
def s4(spark, sf):
    rows = readers.scan_ledger(tx(spark, sf), start="1996-01-01", end="2000-12-31", limit_per_user=3)
    return rows.select("transaction_id", "user_id", "date")


@register(
    "s4_ledger_long_limit_per_user",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY 1 ORDER BY date, transaction_id) AS rn FROM tx)
    SELECT transaction_id, date FROM r WHERE rn <= 2000""",
    [TX_SQL],
)
def s4_long(spark, sf):
    one_key = tx(spark, sf).withColumn("bank", F.lit("one"))
    top = common.top_k_per_group(
        one_key, ["bank"], [F.col("date"), F.col("transaction_id")], 2000, F.col("transaction_id")
    )
    return top.select("transaction_id", "date")


@register(
    "s5_warehouse_scan",
    """SELECT transaction_id, user_id, amount, predicted_category FROM td WHERE date >= TIMESTAMP '1997-06-01'
    AND date <= TIMESTAMP '1998-06-01' ORDER BY date, transaction_id LIMIT 200""",
    [TD_SQL],
)
def s5(spark, sf):
    rows = readers.scan_warehouse(td(spark, sf), start="1997-06-01", end="1998-06-01", limit=200)
    return rows.select("transaction_id", "user_id", "amount", "predicted_category")


@register("s6_json_columns", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def s6(spark, sf):
    rows = table(spark, sf, "events").withColumnRenamed("props", "metadata")
    return readers.parse_json_columns(rows).select("event_id", F.try_variant_get("metadata", "$.k", "int").alias("k"))


@register(
    "s7_drop_label_columns",
    "SELECT transaction_id, coalesce(user_category, nullif(predicted_category, 'Uncategorized'), 'Uncategorized') AS category FROM tx",
    [TX_SQL],
)
def s7(spark, sf):
    stale = td(spark, sf).withColumn("category", F.lit("stale"))
    fresh = rules.resolve_labels(common.drop_label_columns(stale))
    return fresh.select("transaction_id", "category")


@register(
    "s10_point_lookup",
    "SELECT transaction_id, user_id, amount, date, vendor FROM tx WHERE transaction_id = '42'",
    [TX_SQL],
)
def s10(spark, sf):
    ledger_rows = tx(spark, sf)
    owner = ledger_rows.filter(F.col("transaction_id") == "42").select("user_id").scalar()
    return readers.get_transaction(ledger_rows, "42", owner).select("transaction_id", "user_id", "amount", "date", "vendor")


@register(
    "s11_sample_per_template",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY template_used ORDER BY user_id, transaction_id) AS rn FROM tx WHERE template_used > '')
    SELECT template_used, transaction_id, user_id, amount FROM r WHERE rn = 1""",
    [TX_SQL],
)
def s11(spark, sf):
    return readers.sample_per_template(tx(spark, sf)).select("template_used", "transaction_id", "user_id", "amount")


# ------------------------------------------------------------------------------------------------ labels

BLANKED_SQL = f"""bt AS (SELECT transaction_id, CASE WHEN {ID} % 5 = 0 THEN '' ELSE user_category END AS user_category,
  CASE WHEN {ID} % 6 = 0 THEN '' ELSE predicted_category END AS predicted_category, user_subcategory, predicted_subcategory FROM tx)"""


def _blanked(spark, sf):
    return tx(spark, sf).withColumns(
        {
            "user_category": F.when(_id() % 5 == 0, "").otherwise(F.col("user_category")),
            "predicted_category": F.when(_id() % 6 == 0, "").otherwise(F.col("predicted_category")),
        }
    )


@register(
    "f1_labels_for_export",
    """SELECT transaction_id, coalesce(nullif(user_category, ''), nullif(nullif(predicted_category, 'Uncategorized'), ''), 'Uncategorized') AS category,
    coalesce(nullif(user_subcategory, ''), nullif(predicted_subcategory, 'Uncategorized'), 'Uncategorized') AS subcategory FROM bt""",
    [TX_SQL, BLANKED_SQL],
)
def f1(spark, sf):
    return rules.resolve_labels(_blanked(spark, sf)).select("transaction_id", "category", "subcategory")


@register(
    "f1_labels_for_preparation",
    """SELECT transaction_id, coalesce(user_category, nullif(predicted_category, 'Uncategorized'), 'Uncategorized') AS category,
    coalesce(user_subcategory, nullif(predicted_subcategory, 'Uncategorized'), 'Uncategorized') AS subcategory FROM bt""",
    [TX_SQL, BLANKED_SQL],
)
def f1_prep(spark, sf):
    return rules.resolve_labels(_blanked(spark, sf), blank_is_null=False).select("transaction_id", "category", "subcategory")


@register(
    "f2_labels_without_user_columns",
    "SELECT transaction_id, predicted_category AS category, coalesce(predicted_subcategory, 'Uncategorized') AS subcategory FROM tx",
    [TX_SQL],
)
def f2(spark, sf):
    plain = tx(spark, sf).drop("user_category", "user_subcategory")
    return rules.resolve_labels(plain).select("transaction_id", "category", "subcategory")


@register(
    "f3_corrected_flags",
    f"""SELECT transaction_id, user_category IS NOT NULL OR user_subcategory IS NOT NULL OR user_corrected AS by_export,
    user_category IS NOT NULL OR user_subcategory IS NOT NULL AS by_labels, {ID} % 4 = 0 AS by_json FROM tx""",
    [TX_SQL],
)
def f3(spark, sf):
    rows = tx(spark, sf)
    json = rows.drop("user_category", "user_subcategory").withColumn(
        "user_feedback",
        F.when(_id() % 4 == 0, '{"corrected": true}').when(_id() % 4 == 1, '{"corrected": false}').when(_id() % 4 == 2, "{}"),
    )
    return rows.select(
        "transaction_id",
        rules.corrected_by_export(rows).alias("by_export"),
        rules.corrected_by_preparation(rows).alias("by_labels"),
    ).join(json.select("transaction_id", rules.corrected_by_preparation(json).alias("by_json")), "transaction_id")


@register(
    "f4_overrides",
    "SELECT transaction_id, coalesce(user_vendor, vendor) AS vendor, account FROM tx",
    [TX_SQL],
)
def f4(spark, sf):
    rows = tx(spark, sf).withColumnRenamed("account", "account_id")
    return rules.override_fields(rows).select("transaction_id", "vendor", "account")


PATTERN_SQL = """SELECT transaction_id, lower(vendor) AS vendor, {clean} AS vendor_cleaned, template_used, account,
    CAST(day(date) AS VARCHAR) AS day, CAST(month(date) AS VARCHAR) AS month, CAST(year(date) AS VARCHAR) AS year, dayname(date) AS day_name,
    CAST(contains(lower(vendor), 'amz') AS INTEGER) + CAST(contains(lower(vendor), 'a.mazon') AS INTEGER) + CAST(contains(lower(vendor), 'amazon') AS INTEGER) AS amazon,
    CAST(contains(lower(vendor), 'aramark') AS INTEGER) + CAST(contains(lower(vendor), 'jpmc') AS INTEGER) AS aramark,
    CAST(contains(lower(vendor), 'great clips') AS INTEGER) AS great_clips,
    CAST(contains(lower(vendor), 'osu') AS INTEGER) + CAST(contains(lower(vendor), 'ohio state') AS INTEGER) AS ohio_state,
    CAST(contains(lower(vendor), 'firstma') AS INTEGER) + CAST(contains(lower(vendor), 'mohela') AS INTEGER) AS student_loan,
    CAST(contains(lower(vendor), 'spirits') AS INTEGER) + CAST(contains(lower(vendor), 'brewery') AS INTEGER)
      + CAST(contains(lower(vendor), 'tavern') AS INTEGER) + CAST(contains(lower(vendor), 'bar') AS INTEGER) AS bar,
    CAST(contains(lower(vendor), 'supplement') AS INTEGER) AS supplements,
    CAST(contains(lower(vendor), 'best buy') AS INTEGER) AS best_buy, CAST(contains(lower(vendor), 'lending') AS INTEGER) AS loan
    FROM tx""".format(clean=CLEAN)


@register("f6_feature_rows", "SELECT p.*, one AS cleaned_metaphone FROM (" + PATTERN_SQL + ") p LEFT JOIN codes ON vendor_cleaned = cleaned", [TX_SQL, CODES_SQL])
def f6(spark, sf):
    return rules.feature_rows(tx(spark, sf), AS_OF, keep=["transaction_id"])


@register(
    "p11_vendor_pattern_counts",
    "SELECT transaction_id, amazon, aramark, great_clips, ohio_state, student_loan, bar, supplements, best_buy, loan FROM ("
    + PATTERN_SQL + ")",
    [TX_SQL],
)
def p11(spark, sf):
    counts = text.vendor_pattern_counts(F.col("vendor"))
    return tx(spark, sf).select("transaction_id", *[c.alias(n) for n, c in counts.items()])


# -------------------------------------------------------------------------------------------- validation


def _faulty(spark, sf):
    fault = _id() % 11
    return tx(spark, sf).select(
        "transaction_id",
        F.when(fault != 1, F.col("transaction_id")).alias("id"),
        F.when(fault == 2, "30/12/2024").when(fault == 3, None).when(fault == 10, "2024-12-30")
        .otherwise(F.concat(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).alias("date"),
        F.when(fault == 4, "  ").otherwise(F.col("vendor")).alias("description"),
        F.when(fault == 5, "0").when(fault == 6, "12x").when(fault == 9, "0.0").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(fault != 7, F.col("account")).alias("account_id"),
        F.when(fault == 8, " ").otherwise(F.col("user_id")).alias("user_id"),
    )


@register(
    "f7_validation_errors",
    f"""SELECT transaction_id, CASE {ID} % 11 WHEN 1 THEN 'Missing required field: id' WHEN 2 THEN 'Invalid date format'
    WHEN 3 THEN 'Missing required field: date' WHEN 4 THEN 'Description cannot be empty' WHEN 5 THEN 'Amount cannot be zero'
    WHEN 6 THEN 'Invalid amount value' WHEN 7 THEN 'Missing required field: account_id' WHEN 8 THEN 'User ID cannot be empty'
    WHEN 9 THEN 'Amount cannot be zero' ELSE '' END AS errors FROM tx""",
    [TX_SQL],
)
def f7(spark, sf):
    rows = _faulty(spark, sf)
    return rows.select("transaction_id", F.array_join(rules.validation_errors(rows), "; ").alias("errors"))


def _gated(spark, sf):
    return tx(spark, sf).withColumns(
        {
            "id": F.when(_id() % 5 != 0, F.col("transaction_id")).otherwise(""),
            "id_api": F.when(_id() % 10 != 0, F.concat(F.lit("api-"), F.col("transaction_id"))),
            "amount": F.when(_id() % 7 == 0, 0.0).otherwise(F.col("amount")),
            "vendor": F.when(_id() % 9 == 0, "").otherwise(F.col("vendor")),
            "account": F.when(_id() % 8 != 0, F.col("account")),
        }
    )


@register(
    "f8_write_gate",
    f"SELECT transaction_id, {ID} % 10 <> 0 AND {ID} % 7 <> 0 AND {ID} % 9 <> 0 AND {ID} % 8 <> 0 AS writable FROM tx",
    [TX_SQL],
)
def f8(spark, sf):
    rows = _gated(spark, sf)
    return rows.select("transaction_id", rules.is_writable(rows).alias("writable"))


@register(
    "f15_document_keys",
    f"""SELECT transaction_id, CASE WHEN {ID} % 5 <> 0 THEN transaction_id WHEN {ID} % 10 <> 0 THEN concat('api-', transaction_id) END AS key FROM tx""",
    [TX_SQL],
)
def f15(spark, sf):
    rows = _gated(spark, sf)
    return rows.select("transaction_id", rules.document_key(rows).alias("key"))


def _requests(spark, sf):
    return tx(spark, sf).select(
        F.floor(_id() / 8).alias("request_id"),
        (_id() % 8).alias("row_index"),
        F.when(_id() % 801 != 0, F.col("user_id")).alias("user_id"),
        F.col("transaction_id").alias("id"),
        F.when(_id() % 101 != 0, F.col("vendor")).alias("vendor"),
        "amount",
        "date",
        F.when(_id() % 103 != 0, F.col("account")).alias("account"),
        "template_used",
    )


@register(
    "f9_ingest_gate",
    f"""SELECT {ID} // 8 AS request_id, transaction_id AS id FROM tx WHERE {ID} // 8 NOT IN (
      SELECT {ID} // 8 FROM tx WHERE {ID} % 801 = 0 OR {ID} % 101 = 0 OR {ID} % 103 = 0)""",
    [TX_SQL],
)
def f9(spark, sf):
    return rules.accept_requests(_requests(spark, sf)).select("request_id", "id")


@register(
    "f9_ingest_errors",
    f""", e AS (SELECT {ID} // 8 AS request_id, {ID} % 8 AS row_index, CASE WHEN {ID} % 801 = 0 THEN 'Missing required field: user_id'
      ELSE concat('missing fields: ', concat_ws(', ', CASE WHEN {ID} % 101 = 0 THEN 'vendor' END, CASE WHEN {ID} % 103 = 0 THEN 'account' END)) END AS error,
      row_number() OVER (PARTITION BY {ID} // 8 ORDER BY {ID} % 8) AS rn FROM tx WHERE {ID} % 801 = 0 OR {ID} % 101 = 0 OR {ID} % 103 = 0)
    SELECT request_id, row_index, error FROM e WHERE rn = 1""",
    [TX_SQL],
)
def f9_errors(spark, sf):
    return rules.ingest_errors(_requests(spark, sf))


@register(
    "f10_scoring_gate",
    f"SELECT transaction_id, ({ID} % 9 <> 0 OR {ID} % 2 = 0) AND {ID} % 7 <> 0 AS scorable FROM tx",
    [TX_SQL],
)
def f10(spark, sf):
    rows = tx(spark, sf).withColumns(
        {
            "vendor": F.when(_id() % 9 != 0, F.col("vendor")),
            "description": F.when(_id() % 2 == 0, "text"),
            "amount": F.when(_id() % 7 != 0, F.col("amount")),
        }
    )
    return rows.select("transaction_id", rules.is_scorable(rows).alias("scorable"))


@register(
    "f11_enabled_users",
    "SELECT user_id, email FROM usr WHERE email_sync_enabled AND email IS NOT NULL",
    [USR_SQL],
)
def f11(spark, sf):
    return rules.enabled_users(usr(spark, sf)).select("user_id", F.col("contactInformation._email").alias("email"))


@register(
    "f12_find_transactions",
    """SELECT transaction_id, amount, date, vendor FROM tx WHERE date >= TIMESTAMP '1996-01-01' AND date <= TIMESTAMP '2000-01-01'
    AND amount >= 1000 AND amount <= 300000 AND predicted_category = '2-HIGH' AND contains(lower(vendor), 'club')
    ORDER BY date DESC, transaction_id LIMIT 100""",
    [TX_SQL],
)
def f12(spark, sf):
    found = rules.find_transactions(
        tx(spark, sf), date_from="1996-01-01", date_to="2000-01-01", amount_min=1000, amount_max=300000,
        predicted_category="2-HIGH", search="CLUB",
    )
    return found.select("transaction_id", "amount", "date", "vendor")


@register(
    "o2_sorted_by_amount",
    "SELECT transaction_id, amount FROM tx ORDER BY amount, transaction_id LIMIT 100",
    [TX_SQL],
)
def o2(spark, sf):
    return rules.find_transactions(tx(spark, sf), order_by="amount", desc=False).select("transaction_id", "amount")


@register(
    "f13_categorized",
    "SELECT transaction_id, category FROM td WHERE CAST(date AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND category <> 'Uncategorized'",
    [TD_SQL],
)
def f13(spark, sf):
    return rules.categorized(td(spark, sf), "1996-01-01", "1999-12-31").select("transaction_id", "category")


@register(
    "f14_row_defaults",
    f"""SELECT transaction_id, CASE WHEN {ID} % 3 = 0 THEN vendor WHEN {ID} % 3 = 1 THEN concat('m ', vendor) END AS vendor,
    CASE WHEN {ID} % 4 = 0 THEN 'note' WHEN {ID} % 3 = 0 THEN vendor ELSE 'Unknown transaction' END AS description,
    CASE WHEN {ID} % 2 = 0 THEN predicted_category ELSE 'old' END AS predicted_category, date AS last_modified FROM tx""",
    [TX_SQL],
)
def f14(spark, sf):
    rows = tx(spark, sf).select(
        "transaction_id",
        F.when(_id() % 3 == 0, F.col("vendor")).alias("vendor"),
        F.when(_id() % 3 == 1, F.concat(F.lit("m "), "vendor")).alias("merchant"),
        F.when(_id() % 4 == 0, "note").otherwise("").alias("description"),
        F.when(_id() % 2 == 0, F.col("predicted_category")).alias("predicted_category"),
        F.lit("old").alias("category"),
        F.col("date").alias("updated_at"),
    )
    return rules.row_defaults(rows)


def _scored(spark, sf):
    return pred(spark, sf).select(
        "transaction_id",
        F.when(_id() % 4 == 0, "Uncategorized").when(_id() % 4 != 1, F.col("category")).alias("category"),
        F.lit("sub").alias("subcategory"),
        F.col("prediction_confidence").alias("confidence"),
        "model_version",
        F.lit("model").alias("source"),
    )


@register(
    "f16_default_predictions",
    f"""SELECT transaction_id, CASE WHEN {ID} % 4 IN (0, 1) THEN 'Uncategorized' ELSE category END AS category,
    CASE WHEN {ID} % 4 <> 1 THEN 'sub' END AS subcategory, CASE WHEN {ID} % 4 = 1 THEN 0.0 ELSE prediction_confidence END AS confidence,
    CASE WHEN {ID} % 4 <> 1 THEN model_version END AS model_version, CASE WHEN {ID} % 4 = 1 THEN 'unavailable' ELSE 'model' END AS source FROM pred""",
    [PRED_SQL],
)
def f16(spark, sf):
    return rules.fill_default_prediction(_scored(spark, sf))


@register(
    "f17_apply_predictions",
    f"""SELECT transaction_id, CASE WHEN {ID} % 4 IN (0, 1) THEN 'Uncategorized' ELSE category END AS predicted_category,
    CASE WHEN {ID} % 4 NOT IN (0, 1) THEN 'sub' END AS predicted_subcategory,
    CASE WHEN {ID} % 4 IN (0, 1) THEN 0.0 ELSE prediction_confidence END AS prediction_confidence,
    CASE WHEN {ID} % 4 NOT IN (0, 1) THEN model_version END AS model_version FROM pred""",
    [PRED_SQL],
)
def f17(spark, sf):
    out = rules.apply_prediction(_scored(spark, sf))
    return out.select(
        "transaction_id", "predicted_category", "predicted_subcategory", "prediction_confidence", "model_version"
    )


# ------------------------------------------------------------------------------------------------- users


@register(
    "k9_sync_stamps",
    f"""SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM tx) THEN {NOW} END AS last_sync,
    CASE WHEN user_id IN (SELECT user_id FROM tx) THEN 'success' END AS last_sync_status FROM usr""",
    [USR_SQL, TX_SQL],
)
def k9(spark, sf):
    return ledger.stamp_sync(usr(spark, sf), tx(spark, sf), AS_OF).select("user_id", "last_sync", "last_sync_status")


@register(
    "k10_retained_rows",
    f"SELECT feedback_id, feedback_timestamp FROM fb WHERE feedback_timestamp >= {NOW} - INTERVAL 10 DAY",
    [FB_SQL],
)
def k10(spark, sf):
    return ledger.retain_recent(fb(spark, sf), "feedback_timestamp", 10, AS_OF).select("feedback_id", "feedback_timestamp")


# ------------------------------------------------------------------------------------------------- texts


@register("p8_clean_vendor", f"SELECT transaction_id, {CLEAN} AS vendor_cleaned FROM tx", [TX_SQL])
def p8(spark, sf):
    return tx(spark, sf).select("transaction_id", text.clean_vendor(F.col("vendor")).alias("vendor_cleaned"))


@register(
    "p9_vendor_codes",
    f"""SELECT vendor_cleaned, n, trim(concat(one, ' ', two)) AS codes FROM (SELECT {CLEAN} AS vendor_cleaned, count(*) AS n FROM tx GROUP BY 1)
    LEFT JOIN codes ON vendor_cleaned = cleaned""",
    [TX_SQL, CODES_SQL],
)
def p9(spark, sf):
    from ..functions.phonetic import codes

    cleaned = text.clean_vendor(F.col("vendor"))
    return tx(spark, sf).groupBy(cleaned.alias("vendor_cleaned")).agg(F.count("*").alias("n")).withColumn(
        "codes", F.array_join(codes(F.col("vendor_cleaned")), " ")
    )


@register(
    "p10_simple_phonetic",
    "SELECT transaction_id, regexp_replace(upper(vendor), '[^A-Z]', '', 'g') AS code FROM tx",
    [TX_SQL],
)
def p10(spark, sf):
    return tx(spark, sf).select("transaction_id", text.simple_phonetic(F.col("vendor")).alias("code"))


ACCOUNTS = ["Chase CREDIT card", "Checking 12", "my savings", "Brokerage"]


@register(
    "p12_inferred_templates",
    f"""SELECT transaction_id, CASE {ID} % 5 WHEN 0 THEN 'CREDIT_CARD_TEMPLATE' WHEN 1 THEN 'BANK_TEMPLATE_A' WHEN 2 THEN 'BANK_TEMPLATE_B'
    ELSE 'GENERIC_TEMPLATE' END AS template FROM tx""",
    [TX_SQL],
)
def p12(spark, sf):
    account = F.get(F.array(*[F.lit(a) for a in ACCOUNTS]), (_id() % 5).cast("int"))
    return tx(spark, sf).select("transaction_id", text.infer_template(account).alias("template"))


@register(
    "p13_score_keys",
    """SELECT count(*) AS n, count(DISTINCT lower(concat_ws('|', vendor, CAST(amount AS VARCHAR), template_used))) AS keys,
    min(lower(concat_ws('|', vendor, CAST(amount AS VARCHAR), template_used))) AS first_key FROM tx""",
    [TX_SQL],
)
def p13(spark, sf):
    key = text.score_key(F.col("vendor"), F.lit(None).cast("string"), F.col("amount"), F.col("template_used"))
    return tx(spark, sf).withColumn("key", key).agg(
        F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.min("key").alias("first_key")
    )


@register(
    "p14_four_digit_accounts",
    f"SELECT transaction_id, {ID} % 3 = 0 AS ok FROM tx",
    [TX_SQL],
)
def p14(spark, sf):
    account = F.when(_id() % 3 == 0, F.col("account")).when(_id() % 3 == 1, F.concat(F.lit("x"), "account"))
    return tx(spark, sf).select("transaction_id", text.is_four_digits(account).alias("ok"))


# ------------------------------------------------------------------------------------------------- dates


@register(
    "d7_guarded_dates",
    f"""SELECT transaction_id, CASE WHEN {ID} % 6 = 0 THEN {NOW} WHEN {ID} % 5 = 0 THEN {NOW} ELSE date END AS date,
    CASE WHEN {ID} % 6 <> 0 AND {ID} % 5 <> 0 THEN day(date) END AS day,
    CASE WHEN {ID} % 6 <> 0 AND {ID} % 5 <> 0 THEN dayname(date) END AS day_name FROM tx""",
    [TX_SQL],
)
def d7(spark, sf):
    clock = dates.as_clock(AS_OF)
    rows = tx(spark, sf).withColumn(
        "date", F.when(_id() % 6 == 0, None).when(_id() % 5 == 0, F.col("date") + F.expr("INTERVAL '40' YEAR")).otherwise(F.col("date"))
    )
    stated = dates.is_stated(F.col("date"), clock)
    parts = dates.date_parts(F.col("date"))
    return rows.select(
        "transaction_id",
        dates.guarded_date(F.col("date"), clock).alias("date"),
        F.when(stated, parts["day"]).alias("day"),
        F.when(stated, parts["day_name"]).alias("day_name"),
    )


@register(
    "d8_missing_dates",
    f"SELECT transaction_id, CASE WHEN {ID} % 3 = 0 THEN date ELSE {NOW} END AS date FROM tx",
    [TX_SQL],
)
def d8(spark, sf):
    stated = F.when(_id() % 3 == 0, F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")).when(_id() % 3 == 1, "not a date")
    return tx(spark, sf).select(
        "transaction_id", dates.guarded_date(dates.iso_to_utc(stated), dates.as_clock(AS_OF)).alias("date")
    )


@register(
    "d9_date_parts",
    "SELECT transaction_id, day(date) AS day, month(date) AS month, year(date) AS year, dayname(date) AS day_name FROM tx",
    [TX_SQL],
)
def d9(spark, sf):
    return tx(spark, sf).select("transaction_id", *[c.alias(n) for n, c in dates.date_parts(F.col("date")).items()])


@register(
    "d10_date_defaults",
    f"""SELECT transaction_id, CASE WHEN {ID} % 4 = 0 THEN 1 ELSE day(date) END AS day, CASE WHEN {ID} % 4 = 0 THEN 1 ELSE month(date) END AS month,
    CASE WHEN {ID} % 4 = 0 THEN 2024 ELSE year(date) END AS year, CASE WHEN {ID} % 4 = 0 THEN 'Monday' ELSE dayname(date) END AS day_name FROM tx""",
    [TX_SQL],
)
def d10(spark, sf):
    date = F.when(_id() % 4 != 0, F.col("date"))
    parts = dates.date_features(date, dates.as_clock(AS_OF))
    return tx(spark, sf).select("transaction_id", *[c.alias(n) for n, c in parts.items()])


@register(
    "d11_sql_date_functions",
    f"""SELECT event_id, day(ts) AS day, dayname(ts) AS day_name, CAST(ts AS DATE) AS date, date_trunc('hour', ts) AS hour,
    ts > {NOW} - INTERVAL 7 DAY AS recent FROM events""",
)
def d11(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id",
        F.dayofmonth(ts).alias("day"),
        F.date_format(ts, "EEEE").alias("day_name"),
        F.to_date(ts).alias("date"),
        dates.hour_of(ts).alias("hour"),
        (ts > dates.days_before(dates.as_clock(AS_OF), 7)).alias("recent"),
    )
