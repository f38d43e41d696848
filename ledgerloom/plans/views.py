"""Test views: ledger, feedback, prediction, user and message tables derived by Spark from the given tables.

``*_SQL`` are the same views as common table expressions for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import evaluate_once
from ..functions.text import literal_array
from ..operators.templates import TEMPLATE_NAMES

AS_OF = "2024-01-31 00:00:00"
MESSAGES_PER_TASK = 20_000

# Fixed values of the test views.
# Double metaphone codes of the cleaned vendor names below, and of the cleaned customer names.
CODES_SQL = """codes AS (SELECT * FROM (VALUES
  ('amazon com digital', 'AMSNKMTJTL', 'AMSNKMTKTL'), ('amz mktp us k', 'AMSMKTPSK', 'AMTSMKTPSK'), ('a mazon prime', 'AMSNPRM', ''),
  ('aramark jpmc cafe', 'ARMRKJPMKF', ''), ('great clips', 'KRTKLPS', ''), ('osu bookstore', 'ASPKSTR', ''),
  ('the ohio state tavern bar', '0HSTTTFRNPR', 'THSTTTFRNPR'), ('mohela student', 'MHLSTTNT', ''), ('best buy', 'PSTP', ''),
  ('lending club', 'LNTNKKLP', ''), ('sam s online club', 'SMSNLNKLP', ''), ('', '', ''), ('customer', 'KSTMR', '')
) AS c(cleaned, one, two))"""

VENDORS = [
    "AMAZON.COM*DIGITAL", "AMZ Mktp US*2K4", "A.MAZON PRIME", "Aramark JPMC Cafe", "Great Clips #1234",
    "OSU Bookstore", "The Ohio State Tavern & Bar", "MOHELA  Student", "BEST BUY 00012", "Lending Club",
    "SAM'S Online Club", "#### 123",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(literal_array(values), (index + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ------------------------------------------------------------------------------------------------ ledger


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows from orders and customers."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        text(key).alias("transaction_id"),
        text(F.col("o_custkey")).alias("user_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("date"),
        F.lpad(text(F.col("o_custkey") % 10000), 4, "0").alias("account"),
        _pick(TEMPLATE_NAMES, key % 18).alias("template_used"),
        _pick(VENDORS, key % 12).alias("vendor"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("_p"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("predicted_subcategory"),
        F.when(key % 7 == 0, F.col("c_mktsegment")).alias("user_category"),
        F.when(key % 14 == 0, F.col("c_mktsegment")).alias("user_subcategory"),
        F.when(key % 11 == 0, F.upper("c_name")).alias("user_vendor"),
        (key % 21 == 0).alias("user_corrected"),
        F.concat(F.lit("transaction_model_v"), text(8 + key % 3)).alias("model_version"),
        (F.col("o_totalprice") / 500000).alias("prediction_confidence"),
        F.col("o_orderdate").alias("last_modified"),
    ).withColumn("predicted_category", F.coalesce("_p", F.lit("Uncategorized"))).drop("_p")


TX_SQL = f"""tx AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, CAST(o_custkey AS VARCHAR) AS user_id,
         o_totalprice AS amount, o_orderdate AS date,
         lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS account,
         {_sql_list(TEMPLATE_NAMES)}[CAST(o_orderkey % 18 AS INTEGER) + 1] AS template_used,
         {_sql_list(VENDORS)}[CAST(o_orderkey % 12 AS INTEGER) + 1] AS vendor,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Uncategorized' ELSE o_orderpriority END AS predicted_category,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS predicted_subcategory,
         CASE WHEN o_orderkey % 7 = 0 THEN c_mktsegment END AS user_category,
         CASE WHEN o_orderkey % 14 = 0 THEN c_mktsegment END AS user_subcategory,
         CASE WHEN o_orderkey % 11 = 0 THEN upper(c_name) END AS user_vendor,
         o_orderkey % 21 = 0 AS user_corrected,
         concat('transaction_model_v', CAST(8 + o_orderkey % 3 AS VARCHAR)) AS model_version,
         o_totalprice / 500000 AS prediction_confidence, o_orderdate AS last_modified
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def td(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: the ledger with labels resolved."""
    from ..operators import rules

    ledger = rules.resolve_labels(tx(spark, sf_dir))
    return ledger.withColumn("is_user_corrected", rules.corrected_by_export(ledger))


TD_SQL = TX_SQL + """,
td AS (
  SELECT tx.*, coalesce(user_category, nullif(predicted_category, 'Uncategorized'), 'Uncategorized') AS category,
         coalesce(user_subcategory, predicted_subcategory, 'Uncategorized') AS subcategory,
         user_category IS NOT NULL OR user_subcategory IS NOT NULL OR user_corrected AS is_user_corrected
  FROM tx)"""


# ------------------------------------------------------------------------------- feedback and predictions


def fb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback from events, three entries per transaction."""
    events, orders = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    event = F.col("event_id")
    other = F.get_json_object("props", "$.k").cast("int") % 4 == 0
    return events.join(orders, F.col("o_orderkey") == event - event % 3).select(
        event.cast("string").alias("feedback_id"),
        (event - event % 3).cast("string").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("event_type").alias("original_category"),
        F.when(other, "other").otherwise(F.col("event_type")).alias("user_category"),
        (F.col("value") / 500).alias("prediction_confidence"),
        F.concat(F.lit("transaction_model_v"), (8 + event % 3).cast("string")).alias("model_version"),
        F.col("ts").alias("feedback_timestamp"),
    )


FB_SQL = """fb AS (
  SELECT CAST(event_id AS VARCHAR) AS feedback_id, CAST(event_id - event_id % 3 AS VARCHAR) AS transaction_id,
         CAST(o_custkey AS VARCHAR) AS user_id, event_type AS original_category,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 = 0 THEN 'other' ELSE event_type END AS user_category,
         value / 500 AS prediction_confidence,
         concat('transaction_model_v', CAST(8 + event_id % 3 AS VARCHAR)) AS model_version, ts AS feedback_timestamp
  FROM events JOIN orders ON o_orderkey = event_id - event_id % 3)"""


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions log from events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("ts").alias("created_at"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("transaction_model_v"), (8 + F.col("event_id") % 3).cast("string")).alias("model_version"),
        (F.col("value") / 500).alias("prediction_confidence"),
    )


PRED_SQL = """pred AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, ts AS created_at, CAST(user_id AS VARCHAR) AS user_id,
         event_type AS category, concat('transaction_model_v', CAST(8 + event_id % 3 AS VARCHAR)) AS model_version,
         value / 500 AS prediction_confidence
  FROM events)"""


# ------------------------------------------------------------------------------------------------- users


def usr(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    none = lambda kind: F.lit(None).cast(kind)
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("user_id"),
        F.when(key % 50 != 0, key % 3 != 0).alias("email_sync_enabled"),
        F.struct(F.when(key % 20 != 0, F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("_email")).alias(
            "contactInformation"
        ),
        none("timestamp_ntz").alias("last_sync"),
        none("string").alias("last_sync_status"),
    )


USR_SQL = """usr AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id,
         CASE WHEN c_custkey % 50 <> 0 THEN c_custkey % 3 <> 0 END AS email_sync_enabled,
         CASE WHEN c_custkey % 20 <> 0 THEN concat(lower(c_name), '@example.com') END AS email,
         CAST(NULL AS TIMESTAMP) AS last_sync, CAST(NULL AS VARCHAR) AS last_sync_status
  FROM customer)"""


# ---------------------------------------------------------------------------------------------- messages

# Templates that only match the raw body, because their patterns need tags.
_RAW = (4, 8, 9, 11, 14, 15)


# One rendering per template, in registry order. {A} account, {M} money, {N} the plain number, {V} vendor,
# {L} long local time, {S} short local time, {D} month/day/year, {T} month name, day, year.
_BODIES = [
    "CK{A}: withdrawal for {M} at {V} from your card as of {S}",
    "A transaction of {M} at {V} was approved. Visa ending in {A} was used.",
    "Your card ending in {A} was charged ${N} at {V}. Thank you.",
    "<p>You sent {M} to {V}</p><table><tr><td>Account ending in</td><td>(...{A})</td></tr>"
    "<tr><td>Recipient</td><td>{V}</td></tr><tr><td>Sent on</td><td>{L}</td></tr></table>",
    "Your account, last 4 #{A}: on {D}, at {V}, a charge of {M} was made",
    "Last 4 #: {A} Merchant: {V} Amount: {M} Date: {T}",
    "Account ending in {A}\nAmount: {M}\nTransaction Date:: {T} &lt;ok&gt;\nMerchant: {V}",
    "<p>Account ending in (...{A}) You have a direct deposit of {M}</p><table><tr><td>{L}</td></tr></table>",
    "<p>You made a {M} transaction with {V}</p><p>Chase Visa (...{A})</p><table><tr><td>{L}</td></tr></table>",
    "Account ending in {A}: {M} purchase made at {V} on {L}",
    "<table><tr><td>Account</td><td>Chase Sapphire (...{A})</td></tr><tr><td>Date</td><td>{L}</td></tr>"
    "<tr><td>Merchant</td><td>{V}</td></tr><tr><td>Amount</td><td>{M}</td></tr></table>",
    "A {M} external transfer to {V} on this day. Account ending in {A}.",
    "A {M} debit card purchase to {V} on this day. Account ending in {A}.",
    "<table><tr><td>Account</td><td>Chase Checking (...{A})</td></tr><tr><td>Made on</td><td>{L}</td></tr>"
    "<tr><td>Recipient</td><td>{V}</td></tr><tr><td>Amount</td><td>{M}</td></tr></table>",
    "<table><tr><td>Account</td><td>Visa ending in {A}</td></tr><tr><td>Posted</td><td>Merchant</td><td><b>{V}</b></td></tr>"
    "<tr><td>Amount</td><td>{M}</td></tr></table>",
    "We received a deposit for {M} from {V} to CK {A} as of {L}",
    "CK{A} deposit for {M} at {V} from branch",
    "Account ending in (...{A}) Sent on {L} &lt;ok&gt; You sent {M} to {V}",
]


def _body(template: Column, amount: Column, plain: Column, account: Column, vendor: Column, at: Column) -> Column:
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), at)
    fields = {
        "{A}": account,
        "{M}": F.concat(F.lit("$"), amount),
        "{N}": plain,
        "{V}": vendor,
        "{L}": F.concat(F.date_format(local, "MMM d, yyyy 'at' h:mm a"), F.lit(" ET")),
        "{S}": F.concat(F.date_format(local, "M/d/yy h:mm a"), F.lit(" ET")),
        "{D}": F.date_format(at, "MM/dd/yyyy"),
        "{T}": F.date_format(at, "MMM d, yyyy"),
    }
    body = template
    for name, value in fields.items():
        if name in ("{L}", "{S}", "{D}", "{T}"):  # only the date form that the body has is rendered
            value = F.when(template.contains(name), value).when(at.isNotNull(), "")
        body = F.replace(body, F.lit(name), value)
    return body


def msg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rendered message per order: 18 templates by ``o_orderkey % 18``, and broken or unusual forms by
    ``(o_orderkey div 18) % 10`` (see ``MSG_SQL`` for what each should parse to)."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    form = F.floor(key / 18) % 10
    kind = key % 18
    at = F.col("o_orderdate") + F.make_dt_interval(hours=(14 + key % 7).cast("int"), mins=(key % 60).cast("int"))
    raw_only = (kind + 1).isin(*_RAW)
    vendor = F.concat(F.lit("SHOP"), F.when((form == 4) & ~raw_only, "&#35;").otherwise("#"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))
    # a message table has as many files as its size asks for; the test orders are one
    tasks = max(spark.sparkContext.defaultParallelism, -(-orders.count() // MESSAGES_PER_TASK))
    base = orders.repartition(tasks, key).select(
        key.alias("k"), form.alias("form"), kind.alias("kind"), at.alias("at"), raw_only.alias("raw_only"),
        F.col("o_custkey"), vendor.alias("vendor"),
        F.format_number("o_totalprice", 2).alias("amount"),
        F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("plain"),
        F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0").alias("account"),
    )
    base = evaluate_once(base, {"template": _pick(_BODIES, F.col("kind"))})
    base = evaluate_once(base, {"body": _body(*[F.col(c) for c in ("template", "amount", "plain", "account", "vendor", "at")])}).drop("template")
    body = F.col("body")
    body = F.when(F.col("form") == 1, F.regexp_replace(body, r"\$[0-9,.]*[0-9]", "nothing")).otherwise(body)
    body = F.when(
        (F.col("form") == 3) & ~F.col("raw_only"), F.concat(F.substring(body, 1, 9), F.lit("=\r\n"), F.substr(body, F.lit(10)))
    ).otherwise(body)
    data = F.base64(F.encode(body, "UTF-8"))
    for old, new in (("+", "-"), ("/", "_"), ("\r", ""), ("\n", "")):
        data = F.replace(data, F.lit(old), F.lit(new))
    base, data = evaluate_once(base, {"data": data}).drop("body"), F.col("data")
    half = (F.length(data) / 2).cast("int")
    data = (
        F.when(F.col("form") == 6, F.lit("%%%broken%%%"))
        .when(F.col("form") == 7, F.concat(F.lit('["'), F.substr(data, F.lit(1), half), F.lit('"," ","'), F.substr(data, half + 1), F.lit('"]')))
        .otherwise(data)
    )
    base = base.withColumn("data", data)
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    subject = (
        F.when(F.col("kind") == 3, F.concat(F.lit("You sent $"), F.col("amount"), F.lit(" from account ending in 1")))
        .when(F.col("kind") == 8, F.concat(F.lit("Your $"), F.col("amount"), F.lit(" transaction with "), F.col("vendor")))
        .when(F.col("kind") == 9, "Chase Alert")
        .otherwise(F.concat(F.lit("Transaction notice "), F.col("kind").cast("string")))
    )
    sender = F.concat(F.lit("alerts"), F.col("kind").cast("string"), F.lit("@bank.example.com"))
    sent = F.concat(F.date_format("at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    name = F.when(F.col("k") % 3 == 0, "message-id").otherwise("Message-ID")
    headers = F.filter(
        F.array(
            pair("From", sender),
            pair("Subject", F.lit("overwritten")),
            pair("Subject", subject),
            F.when(F.col("form") != 0, pair("Date", sent)),
            F.when(F.col("k") % 25 != 0, F.struct(name.alias("name"), F.concat(F.lit("<ord-"), F.col("k").cast("string"), F.lit("@example.com>")).alias("value"))),
        ),
        lambda h: h.isNotNull(),
    )
    leaf = "struct<mimeType:string,body:struct<data:string>,parts:array<struct<mimeType:string,body:struct<data:string>,parts:array<struct<mimeType:string,body:struct<data:string>,parts:string>>>>>"
    parts = (
        F.when(F.col("form") == 2, F.to_json(F.array(F.struct(F.lit("text/plain").alias("mimeType"), F.struct("data").alias("body")))))
        .when(
            F.col("form") == 5,
            F.to_json(
                F.array(
                    F.struct(F.lit("text/plain").alias("mimeType"), F.struct(F.lit("anVuaw==").alias("data")).alias("body"), F.lit(None).cast("string").alias("parts")),
                    F.struct(F.lit("multipart/alternative").alias("mimeType"), F.struct(F.lit(None).cast("string").alias("data")).alias("body"),
                             F.lit("@").alias("parts")),
                )
            ),
        )
    )
    nested = F.concat(F.lit('[{"mimeType":"text/html","body":{"data":"'), F.col("data"), F.lit('"}}]'))
    parts = F.from_json(F.replace(parts, F.lit('"@"'), nested), f"array<{leaf}>")
    top = F.when(~F.col("form").isin(2, 5), F.col("data"))
    return base.select(
        F.col("k").cast("string").alias("id"),
        F.concat(F.lit("thread"), F.col("k").cast("string")).alias("threadId"),
        F.when(F.col("k") % 4 == 0, F.array(F.lit("INBOX"))).otherwise(F.array(F.lit("INBOX"), F.lit("UNREAD"))).alias("labelIds"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.struct(
            F.lit(None).cast("string").alias("mimeType"),
            headers.alias("headers"),
            F.struct(top.alias("data")).alias("body"),
            parts.alias("parts"),
        ).alias("payload"),
    )


# What each message should parse to. No pattern is involved: the values are those it was rendered from.
MSG_SQL = f"""m0 AS (
  SELECT o_orderkey AS k, o_orderkey % 18 AS kind, (o_orderkey // 18) % 10 AS form, o_custkey, o_totalprice, o_orderdate,
         o_orderdate + to_hours(CAST(14 + o_orderkey % 7 AS INTEGER)) + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS sent,
         lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS acct
  FROM orders),
msg AS (
  SELECT k, kind, form, sent, CAST(k AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id,
         CASE WHEN k % 25 = 0 THEN CAST(k AS VARCHAR) ELSE concat('ord-', CAST(k AS VARCHAR), '@example.com') END AS message_id,
         concat('alerts', CAST(kind AS VARCHAR), '@bank.example.com') AS from_addr,
         CASE WHEN form IN (1, 6) THEN 'no_template' ELSE 'ok' END AS parse_status,
         CASE WHEN form NOT IN (1, 6) THEN {_sql_list(TEMPLATE_NAMES)}[CAST(kind AS INTEGER) + 1] END AS template_used,
         CASE WHEN form NOT IN (1, 6) THEN CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) END AS amount,
         CASE WHEN form NOT IN (1, 6) THEN acct END AS account,
         CASE WHEN form IN (1, 6) THEN NULL WHEN kind = 7 THEN 'Direct Deposit'
              ELSE concat('SHOP#', lpad(CAST(o_custkey AS VARCHAR), 6, '0')) END AS vendor,
         CASE WHEN form <> 0 THEN sent
              WHEN kind IN (0, 3, 7, 8, 9, 10, 13, 15, 17) THEN sent
              WHEN kind IN (4, 5) THEN o_orderdate
              ELSE TIMESTAMP '{AS_OF}' END AS date,
         CASE WHEN form IN (1, 6) THEN 'header'
              WHEN kind IN (0, 3, 4, 5, 7, 8, 9, 10, 13, 15, 17) THEN 'text'
              WHEN form = 0 THEN 'as_of' ELSE 'header' END AS date_source
  FROM m0)"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import extraction

    return extraction.parse_messages(msg(spark, sf_dir), AS_OF)
