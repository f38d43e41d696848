"""Registered message extraction: each query parses all rendered messages and is checked against the values
they were rendered from."""

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import extraction
from ..operators.ledger_table import LedgerTable
from ..operators.templates import TEMPLATE_NAMES, TEMPLATES
from ..session import reliable_checkpoint, work_path
from . import jobs
from .registry import register
from .views import AS_OF, MSG_SQL, TX_SQL, USR_SQL, msg, parsed, tx, usr

NOW = f"TIMESTAMP '{AS_OF}'"
BY_NAME = {t.name: t for t in TEMPLATES}


@register("t2_first_match", "SELECT id, template_used FROM msg", [MSG_SQL])
def t2(spark, sf):
    return parsed(spark, sf).select("id", "template_used")


@register(
    "t3_sender_gate",
    "SELECT id, CASE WHEN kind = 2 AND form NOT IN (1, 6) THEN template_used END AS template_used FROM msg",
    [MSG_SQL],
)
def t3(spark, sf):
    gated = [
        replace(BY_NAME["Target Credit Card"], email_from="somebody@example.com"),
        replace(BY_NAME["US Bank - Credit Card"], email_from="alerts2@bank.example.com"),
    ]
    return extraction.parse_messages(msg(spark, sf), AS_OF, gated).select("id", "template_used")


@register(
    "t4_subject_gate",
    "SELECT id, CASE WHEN kind IN (8, 9) AND form NOT IN (1, 6) THEN template_used END AS template_used FROM msg",
    [MSG_SQL],
)
def t4(spark, sf):
    gated = [BY_NAME["Chase Transaction Alert - New1"], BY_NAME["Chase Test Format"]]
    return extraction.parse_messages(msg(spark, sf), AS_OF, gated).select("id", "template_used")


@register(
    "t5_body_forms",
    """SELECT id, CASE WHEN template_used IS NULL THEN NULL WHEN kind IN (3, 7, 8, 10, 13, 14) THEN 'raw' ELSE 'sanitized' END AS body_type FROM msg""",
    [MSG_SQL],
)
def t5(spark, sf):
    return parsed(spark, sf).select("id", "body_type")


@register("t6_amounts_and_accounts", "SELECT id, amount, account FROM msg", [MSG_SQL])
def t6(spark, sf):
    return parsed(spark, sf).select("id", "amount", "account")


@register("t7_vendors", "SELECT id, vendor FROM msg", [MSG_SQL])
def t7(spark, sf):
    return parsed(spark, sf).select("id", "vendor")


@register(
    "t8_accepted_per_template",
    "SELECT template_used, count(*) AS n, count(DISTINCT account) AS accounts FROM msg GROUP BY 1",
    [MSG_SQL],
)
def t8(spark, sf):
    return parsed(spark, sf).groupBy("template_used").agg(F.count("*").alias("n"), F.count_distinct("account").alias("accounts"))


@register(
    "t9_cell_template",
    "SELECT id, CASE WHEN kind = 14 THEN amount END AS amount, CASE WHEN kind = 14 THEN account END AS account, CASE WHEN kind = 14 THEN vendor END AS vendor FROM msg",
    [MSG_SQL],
)
def t9(spark, sf):
    only = [BY_NAME["Chase Credit Cards - HTML Template"]]
    return extraction.parse_messages(msg(spark, sf), AS_OF, only).select("id", "amount", "account", "vendor")


@register(
    "t11_transactions",
    "SELECT message_id, template_used, amount, account, vendor, date, date_source FROM msg WHERE parse_status = 'ok'",
    [MSG_SQL],
)
def t11(spark, sf):
    ok, _ = extraction.split_parsed(parsed(spark, sf))
    return ok.select("message_id", "template_used", "amount", "account", "vendor", "date", "date_source")


@register(
    "t12_vendor_from_subject",
    "SELECT id, CASE WHEN kind = 8 AND form NOT IN (1, 6) THEN vendor END AS vendor FROM msg",
    [MSG_SQL],
)
def t12(spark, sf):
    base = BY_NAME["Chase Transaction Alert - New1"]
    no_vendor = replace(base, vendor=r"(?:nothing like this ([a-z]+) in any body)")
    return extraction.parse_messages(msg(spark, sf), AS_OF, [no_vendor]).select("id", "vendor")


@register("t13_outcomes", "SELECT parse_status, count(*) AS n FROM msg GROUP BY 1", [MSG_SQL])
def t13(spark, sf):
    return parsed(spark, sf).groupBy("parse_status").agg(F.count("*").alias("n"))


@register(
    "t13_quarantine",
    "SELECT message_id, user_id, parse_status AS reason FROM msg WHERE parse_status <> 'ok'",
    [MSG_SQL],
)
def t13_quarantine(spark, sf):
    _, bad = extraction.split_parsed(parsed(spark, sf))
    return bad.select("message_id", "user_id", "reason")


@register(
    "t14_template_samples",
    "SELECT template_used, min(message_id) AS message_id FROM msg WHERE parse_status = 'ok' AND amount <> 0 AND vendor <> '' GROUP BY 1",
    [MSG_SQL],
)
def t14(spark, sf):
    return extraction.template_samples(parsed(spark, sf)).select("template_used", "message_id")


def _mixed_senders(spark, sf):
    """Unreadable messages come from senders of their own, except every third. Read twice, so written once."""
    rows = reliable_checkpoint(parsed(spark, sf), "parsed")
    odd = (F.col("parse_status") != "ok") & (F.col("id").cast("bigint") % 3 != 0)
    return rows.withColumn("from_addr", F.when(odd, "unknown@example.com").otherwise(F.col("from_addr")))


@register(
    "t14_unmatched_samples",
    """, r AS (SELECT message_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY message_id) AS rn FROM msg
      WHERE parse_status <> 'ok' AND k % 3 <> 0) SELECT message_id, user_id FROM r WHERE rn <= 2""",
    [MSG_SQL],
)
def t14_unmatched(spark, sf):
    return extraction.unmatched_senders(_mixed_senders(spark, sf)).select("message_id", "user_id")


@register(
    "j10_unmatched_senders",
    "SELECT message_id, user_id FROM msg WHERE parse_status <> 'ok' AND k % 3 <> 0",
    [MSG_SQL],
)
def j10(spark, sf):
    rows = _mixed_senders(spark, sf)
    known = rows.filter(F.col("template_used").isNotNull()).select("from_addr").distinct()
    return rows.filter(F.col("template_used").isNull()).join(known, "from_addr", "left_anti").select("message_id", "user_id")


@register(
    "u3_missing_templates",
    "SELECT unnest(['Never Seen', 'Old Bank']) AS template_used EXCEPT SELECT template_used FROM msg",
    [MSG_SQL],
)
def u3_missing(spark, sf):
    return extraction.missing_templates(parsed(spark, sf), ["Never Seen", *TEMPLATE_NAMES, "Old Bank"])


LOADED_SQL = f"""unread AS (SELECT * FROM msg WHERE k % 4 <> 0 AND user_id IN (SELECT user_id FROM usr WHERE email_sync_enabled AND email IS NOT NULL)),
good AS (SELECT message_id AS transaction_id, id AS id_api, user_id, account, template_used, vendor, amount,
  CASE WHEN date <= {NOW} THEN date ELSE {NOW} END AS date FROM unread WHERE parse_status = 'ok')"""


def _known_third(spark, sf):
    """A ledger that already knows a third of the messages' transactions."""
    return tx(spark, sf).select(
        F.concat(F.lit("ord-"), "transaction_id", F.lit("@example.com")).alias("transaction_id"), F.lit(None).cast("string").alias("id_api"),
        "user_id", "account", "template_used", F.lit("old vendor").alias("vendor"), F.lit("").alias("vendor_cleaned"), F.lit(0.5).alias("amount"), "date",
        "predicted_category", "user_category", F.col("date").alias("created_at"), F.col("date").alias("last_modified"), F.lit("processed").alias("status"),
    ).filter(F.regexp_extract("transaction_id", r"(\d+)", 1).cast("bigint") % 3 == 0)


def _loaded(spark, sf):
    """All unread messages into that ledger."""
    return jobs.extract_and_load(msg(spark, sf), _known_third(spark, sf), AS_OF, usr(spark, sf))


B1_SQL = f""", old AS (SELECT concat('ord-', transaction_id, '@example.com') AS transaction_id, user_id, date, user_category, predicted_category
      FROM tx WHERE CAST(transaction_id AS BIGINT) % 3 = 0)
    SELECT coalesce(g.transaction_id, o.transaction_id) AS transaction_id, coalesce(g.user_id, o.user_id) AS user_id,
      coalesce(g.vendor, 'old vendor') AS vendor, coalesce(g.amount, 0.5) AS amount, coalesce(g.date, o.date) AS date,
      CASE WHEN g.transaction_id IS NOT NULL THEN 'Uncategorized' ELSE o.predicted_category END AS predicted_category, o.user_category,
      coalesce(o.date, {NOW}) AS created_at, CASE WHEN g.transaction_id IS NOT NULL THEN {NOW} ELSE o.date END AS last_modified
    FROM good g FULL JOIN old o ON g.transaction_id = o.transaction_id AND g.user_id = o.user_id"""
B1_COLUMNS = ["transaction_id", "user_id", "vendor", "amount", "date", "predicted_category", "user_category", "created_at", "last_modified"]


@register("b1_extract_and_load", B1_SQL, [MSG_SQL, USR_SQL, LOADED_SQL, TX_SQL])
def b1(spark, sf):
    return _loaded(spark, sf).ledger.select(*B1_COLUMNS)


@register("b1_stored_ledger", B1_SQL, [MSG_SQL, USR_SQL, LOADED_SQL, TX_SQL])
def b1_stored(spark, sf):
    """The same run into a stored table, twice: the second run changes nothing."""
    table = LedgerTable.create(_known_third(spark, sf), work_path(spark, "b1-ledger"), buckets=8)
    for _ in range(2):
        loaded = jobs.extract_and_load(msg(spark, sf), table, AS_OF, usr(spark, sf))
    return loaded.ledger.select(*B1_COLUMNS)


@register(
    "b1_run_outcomes",
    """SELECT user_id, count(*) AS stored FROM good GROUP BY 1""",
    [MSG_SQL, USR_SQL, LOADED_SQL],
)
def b1_outcomes(spark, sf):
    return _loaded(spark, sf).outcomes.groupBy("user_id").agg(F.count_if(F.col("status") == "stored").alias("stored"))


@register(
    "b1_cleaned_vendors",
    """SELECT transaction_id, CASE WHEN vendor = 'Direct Deposit' THEN 'direct deposit' ELSE 'shop' END AS vendor_cleaned, day(date) AS day, dayname(date) AS day_name FROM good""",
    [MSG_SQL, USR_SQL, LOADED_SQL],
)
def b1_clean(spark, sf):
    return _loaded(spark, sf).accepted.select("transaction_id", "vendor_cleaned", "day", "day_name")


@register(
    "f7_valid_transactions",
    "SELECT message_id AS id, CAST(0 AS INTEGER) AS n_errors FROM msg WHERE parse_status = 'ok'",
    [MSG_SQL],
)
def f7_valid(spark, sf):
    ok, _ = extraction.split_parsed(parsed(spark, sf))
    return jobs.stage_transactions(ok).select("id", F.size("errors").alias("n_errors"))
