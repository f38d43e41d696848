"""Registered body, text and date expressions, checked on the given documents, pages and orders."""

from pyspark.sql import functions as F

from ..functions import dates, mime, text
from ..functions.staging import evaluate_once
from ..operators import extraction
from .registry import register
from .views import AS_OF, MSG_SQL, msg, table

NOW = f"TIMESTAMP '{AS_OF}'"


@register(
    "p1_headers",
    """SELECT id, from_addr, CASE kind WHEN 9 THEN 'Chase Alert'
    WHEN 3 THEN concat('You sent $', format('{:,.2f}', price), ' from account ending in 1')
    WHEN 8 THEN concat('Your $', format('{:,.2f}', price), ' transaction with ', CASE WHEN form = 4 AND kind NOT IN (3, 7, 8, 10, 13, 14) THEN 'SHOP&#35;' ELSE 'SHOP#' END, lpad(cust, 6, '0'))
    ELSE concat('Transaction notice ', CAST(kind AS VARCHAR)) END AS subject
    FROM (SELECT msg.*, o_totalprice AS price, CAST(o_custkey AS VARCHAR) AS cust FROM msg JOIN orders ON o_orderkey = k)""",
    [MSG_SQL],
)
def p1(spark, sf):
    headers = F.col("payload.headers")
    return msg(spark, sf).select(
        "id", text.header(headers, "From").alias("from_addr"), text.header(headers, "Subject").alias("subject")
    )


@register("p2_message_ids", "SELECT id, message_id FROM msg", [MSG_SQL])
def p2(spark, sf):
    return msg(spark, sf).select("id", text.message_id(F.col("payload.headers"), F.col("id")).alias("message_id"))


def _encoded(column):
    """base64url text of a column, as a mail client writes it."""
    return F.translate(F.base64(F.encode(column, "UTF-8")), "+/\r\n", "-_")


@register(
    "p3_base64url",
    "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS digest, CASE WHEN doc_id % 5 <> 0 THEN length(text) END AS n FROM documents",
)
def p3(spark, sf):
    data = F.when(F.col("doc_id") % 5 == 0, F.lit("%=broken=%A")).otherwise(_encoded(F.col("text")))
    docs = table(spark, sf, "documents").select("doc_id", mime.decode_base64url(data).alias("body"))
    return docs.select("doc_id", F.md5("body").alias("digest"), F.length("body").alias("n"))


def _page_messages(spark, sf):
    """Pages as messages: a body, two parts, nested parts, a plain part."""
    pages = table(spark, sf, "pages")
    kind = F.col("page_id") % 4
    html, url = _encoded(F.col("html")), _encoded(F.col("url"))
    part = lambda mime_type, data: F.concat(
        F.lit('{"mimeType":"' + mime_type + '","body":{"data":"'), data, F.lit('"}}')
    )
    parts = (
        F.when(kind == 1, F.concat(F.lit("["), part("text/plain", url), F.lit(","), part("text/html", html), F.lit("]")))
        .when(
            kind == 2,
            F.concat(F.lit('[{"mimeType":"multipart/mixed","parts":['), part("text/html", html), F.lit(','), part("text/plain", url),
                     F.lit("]},"), part("text/html", url), F.lit("]")),
        )
        .when(kind == 3, F.concat(F.lit("["), part("text/plain", url), F.lit("]")))
    )
    leaf = "struct<mimeType:string,body:struct<data:string>,parts:string>"
    tree = f"array<struct<mimeType:string,body:struct<data:string>,parts:array<struct<mimeType:string,body:struct<data:string>,parts:array<{leaf}>>>>>"
    payload = F.struct(
        F.lit(None).cast("string").alias("mimeType"),
        F.struct(F.when(kind == 0, html).alias("data")).alias("body"),
        F.from_json(parts, tree).alias("parts"),
    )
    return pages.select("page_id", payload.alias("payload"))


@register(
    "p4_chosen_bodies",
    """SELECT page_id, md5(CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN html WHEN 2 THEN concat(html, chr(10), chr(10), url) ELSE url END) AS digest FROM pages""",
)
def p4(spark, sf):
    return _page_messages(spark, sf).select("page_id", F.md5(mime.raw_body(F.col("payload"), mime.leaf_parts(F.col("payload")))).alias("digest"))


@register("p5_joined_body_data", "SELECT page_id, md5(html) AS digest FROM pages")
def p5(spark, sf):
    data = _encoded(F.col("html"))
    cut = (F.length(data) / 3).cast("int")
    listed = F.to_json(F.array(F.substr(data, F.lit(1), cut), F.lit("  "), F.substr(data, cut + 1)))
    pages = table(spark, sf, "pages").withColumn("data", listed)
    return pages.select("page_id", F.md5(mime.decode_base64url(mime.joined_data(F.col("data")))).alias("digest"))


@register("p6_quoted_printable", "SELECT doc_id, md5(text) AS digest FROM documents")
def p6(spark, sf):
    bytes_ = F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(..)", "=$1")
    folded = F.regexp_replace(bytes_, "(.{72})", "$1=\r\n")
    # every other document only escapes what it must
    light = F.replace(F.col("text"), F.lit("="), F.lit("=3D"))
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, folded).otherwise(light).alias("body"))
    return docs.select("doc_id", F.md5(mime.decode_quoted_printable(F.col("body"))).alias("digest"))


SANITIZE_SQL = r"""u AS (SELECT page_id, url_decode(regexp_replace(regexp_replace(replace(replace(replace(html, '%', '%25'), '+', '%2B'), '==', '%3D'),
    '=(\r[^\n]*)?\n', '', 'g'), '=([0-9A-Fa-f]{2})', '%\1', 'g')) AS t FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script.*?>.*?</script>', '', 'g'),
    '(?is)<style.*?>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', ' ', 'g') AS t FROM u),
e AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(regexp_replace(t, '[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}\x{85}]+', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g') AS t FROM s)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '&[a-zA-Z0-9#]+;', '', 'g'), '[^\x20-\x7E\n]', '', 'g')) AS body FROM e"""


@register("p7_sanitized_pages", "WITH " + SANITIZE_SQL)
def p7(spark, sf):
    return mime.sanitize_into(table(spark, sf, "pages"), "html", "body").select("page_id", "body")


@register(
    "p7_entities",
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'a & b <c> "d"' WHEN 1 THEN 'it''s $5 A' WHEN 2 THEN 'caf and 2024' WHEN 3 THEN 'tail'
    WHEN 4 THEN 'AT&T & co' WHEN 5 THEN 'x y' WHEN 6 THEN '5 < 6' ELSE '50% (half)' END AS body, md5(html) AS digest FROM pages""",
)
def p7_entities(spark, sf):
    """Each page's whole html, escaped by one of four rules and decoded again, next to unusual forms of references."""
    forms = {"&": ["&amp;", "&#38;", "&#x26;", "&AMP;"], "<": ["&lt;", "&#60;", "&#x3C;", "&LT;"], ">": ["&gt;", "&#62;", "&#x3e;", "&GT;"],
             '"': ["&quot;", "&#34;", "&#x22;", "&QUOT;"], "'": ["&apos;", "&#39;", "&#x27;", "&apos;"], "/": ["&sol;", "&#47;", "&#x2F;", "&sol;"]}
    escaped = F.col("html")
    for sign, ways in forms.items():
        escaped = F.replace(escaped, F.lit(sign), F.get(F.array(*[F.lit(w) for w in ways]), (F.col("page_id") % 4).cast("int")))
    samples = [
        "a &amp; b &lt;c&gt; &quot;d&quot;", "it&apos;s &#36;5 &#x41;", "caf&eacute; and &copy2024", "&amp;lt;tail&nbsp;",
        "AT&T & co", "x&#32;y", "5 &lt 6", "50&percnt; &lpar;half&rpar;",
    ]
    sample = F.get(F.array(*[F.lit(s) for s in samples]), (F.col("page_id") % 8).cast("int"))
    pages = evaluate_once(table(spark, sf, "pages"), {"sample": sample, "escaped": escaped})
    decoded = F.md5(mime.unescape_entities(F.col("escaped"))).alias("digest")
    return mime.sanitize_into(pages, "sample", "body").select("page_id", "body", decoded)


# -------------------------------------------------------------------------------------------- extraction


@register(
    "t9_table_cells",
    """SELECT page_id, lpad(CAST(page_id AS VARCHAR), 4, '0') AS account, concat('$', CAST(page_id AS VARCHAR), '.50') AS amount, 'SHOP A' AS vendor FROM pages""",
)
def t9_cells(spark, sf):
    key = F.col("page_id").cast("string")
    body = F.concat(
        F.lit("<TABLE><tr><td>Account</td><td class='x'><b>Visa ending in "), F.lpad(key, 4, "0"),
        F.lit("</b></td></tr><tr><td>Posted</td><td> </td><td>Merchant</td><td><i>SHOP</i> A</td></tr><tr><td>Amount</td><td>$"),
        key, F.lit(".50</td></tr></TABLE>"), F.col("url"),
    )
    cells = table(spark, sf, "pages").select("page_id", extraction.cell_texts(body).alias("cells"))
    fields = extraction.cell_fields(F.col("cells"))
    return cells.select("page_id", *[c.alias(n) for n, c in fields.items()])


@register(
    "t10_amounts",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 1 THEN -CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE)
    ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) END AS amount FROM orders""",
)
def t10(spark, sf):
    money = F.format_number("o_totalprice", 2)
    shown = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("$"), money))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("($"), money, F.lit(")")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit(" "), money, F.lit(" ")))
        .when(F.col("o_orderkey") % 5 == 3, F.replace(money, F.lit(","), F.lit("")))
        .otherwise(F.concat(money, F.lit(" USD")))
    )
    return table(spark, sf, "orders").select("o_orderkey", text.parse_amount(shown).alias("amount"))


# ------------------------------------------------------------------------------------------------- dates

AT_SQL = """o AS (SELECT o_orderkey AS k, o_orderdate + to_hours(CAST(14 + o_orderkey % 7 AS INTEGER)) + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS sent FROM orders)"""


def _sent(spark, sf):
    key = F.col("o_orderkey")
    at = F.col("o_orderdate") + F.make_dt_interval(hours=(14 + key % 7).cast("int"), mins=(key % 60).cast("int"))
    return table(spark, sf, "orders").select(key.alias("k"), at.alias("sent"))


def _case(index, values):
    out = F.when(index == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        out = out.when(index == i, value)
    return out


# How each accepted format is written by Spark, with a time or only a day.
_WRITTEN = [
    ("MMM d, yyyy 'at' h:mm a", True), ("MMMM d, yyyy 'at' hh:mm a", True), ("yyyy-MM-dd'T'HH:mm:ss", True), ("yyyy-MM-dd", False),
    ("MM/dd/yyyy", False), ("M/d/yy", False), ("MMM d, yyyy", False), ("MMMM dd, yyyy", False), ("yyyy-MM-dd HH:mm:ss", True),
    ("MM/dd/yy h:mm a", True), ("EEE, dd MMM yyyy HH:mm:ss '+0000'", True), ("yyyy-MM-dd'T'HH:mm:ss'+00:00'", True),
    ("yyyy-MM-dd HH:mm:ss'Z'", True), ("dd/MM/yyyy HH:mm:ss'+0000'", True), ("yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'", True),
]


@register(
    "d1_date_formats",
    """SELECT k, CASE WHEN k % 16 = 15 THEN NULL WHEN k % 16 IN (3, 4, 5, 6, 7) THEN date_trunc('day', sent) ELSE sent END AS date FROM o""",
    [AT_SQL],
)
def d1(spark, sf):
    written = _case(F.col("k") % 16, [F.date_format("sent", p) for p, _ in _WRITTEN] + [F.lit("some day")])
    return _sent(spark, sf).withColumn("written", written).select("k", dates.parse_date(F.col("written")).alias("date"))


ZONES = [
    ("ET", "America/New_York"), ("CT", "America/Chicago"), ("MT", "America/Denver"), ("PT", "America/Los_Angeles"), ("GMT", "UTC"),
    ("+0530", "+05:30"), ("-0800", "-08:00"), ("", "Europe/Berlin"),
]


@register("d2_zones", "SELECT k, sent AS date FROM o", [AT_SQL])
def d2(spark, sf):
    zone = F.col("k") % len(ZONES)
    forms = []
    for label, name in ZONES:
        local = F.convert_timezone(F.lit("UTC"), F.lit(name), F.col("sent"))
        if label[:1] in "+-" and label:
            forms.append(F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(label)))
        else:
            forms.append(F.concat(F.date_format(local, "MMM d, yyyy 'at' h:mm a"), F.lit(f" {label}" if label else "")))
    rows = _sent(spark, sf).withColumn("written", _case(zone, forms))
    return rows.select("k", dates.parse_date(F.col("written"), default_zone="Europe/Berlin").alias("date"))


@register("d3_stripped_zone_names", "SELECT k, strftime(sent, '%Y-%m-%d %H:%M') AS plain FROM o", [AT_SQL])
def d3(spark, sf):
    name = _case(F.col("k") % 5, [F.lit(z) for z in ("ET", "CT", "MT", "PT", "GMT")])
    rows = _sent(spark, sf).withColumn("plain", F.date_format("sent", "yyyy-MM-dd HH:mm"))
    return rows.select("k", dates.drop_zone_names(F.concat("plain", F.lit(" "), name)).alias("plain"))


@register("d4_midnight_fill", "SELECT k, sent AS date FROM o", [AT_SQL])
def d4(spark, sf):
    header = F.concat(F.date_format("sent", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    rows = _sent(spark, sf).select("k", F.date_format("sent", "MMM d, yyyy").alias("written"), header.alias("header"))
    return rows.select("k", dates.parse_date(F.col("written"), F.col("header")).alias("date"))


@register(
    "d5_header_dates",
    "SELECT k, CASE WHEN k % 7 <> 6 THEN sent END AS date FROM o",
    [AT_SQL],
)
def d5(spark, sf):
    local = lambda zone: F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("sent"))
    stamp = lambda c, suffix, p="EEE, d MMM yyyy HH:mm:ss": F.concat(F.date_format(c, p), F.lit(suffix))
    forms = [
        stamp(F.col("sent"), " +0000"), stamp(F.col("sent"), " +0000 (UTC)"), stamp(local("-05:00"), " -0500"), stamp(F.col("sent"), " GMT"),
        stamp(local("-07:00"), " PDT"), stamp(local("+05:30"), " +0530", "dd MMM yyyy HH:mm"), F.lit("yesterday"),
    ]
    rows = _sent(spark, sf).withColumn("header", _case(F.col("k") % 7, forms))
    return rows.select("k", dates.header_instant(F.col("header")).alias("date"))


@register(
    "d6_iso_dates",
    f"SELECT k, CASE k % 6 WHEN 0 THEN date_trunc('day', sent) WHEN 5 THEN {NOW} WHEN 4 THEN {NOW} ELSE sent END AS date FROM o",
    [AT_SQL],
)
def d6(spark, sf):
    local = F.convert_timezone(F.lit("UTC"), F.lit("-05:00"), F.col("sent"))
    forms = [
        F.date_format("sent", "yyyy-MM-dd"), F.date_format("sent", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("sent", "yyyy-MM-dd'T'HH:mm:ss"),
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss'-05:00'"), F.lit(""), F.lit("12/30/2024"),
    ]
    rows = _sent(spark, sf).withColumn("written", _case(F.col("k") % 6, forms))
    return rows.select("k", F.coalesce(dates.iso_to_utc(F.col("written")), dates.as_clock(AS_OF)).alias("date"))
