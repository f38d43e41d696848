"""Golden messages and the decisions about unusual ones."""

import base64
from dataclasses import replace

import pytest

from ledgerloom import schemas
from ledgerloom.operators import extraction
from ledgerloom.operators.templates import TEMPLATES, Template, always_captures, groups
from ledgerloom.plans import jobs, views

AS_OF = "2026-01-01 00:00:00"
DATE = "Thu, 2 Jan 2025 06:33:33 +0000"
BY_NAME = {t.name: t for t in TEMPLATES}


def encode(body):
    return base64.urlsafe_b64encode(body.encode()).decode()


def message(body, subject="Chase Alert", date=DATE, key="12345", parts=None):
    headers = [("From", "no-reply@chase.com"), ("Subject", subject)] + ([("Date", date)] if date else [])
    data = None if parts is not None else encode(body)
    return (key, "t", ["INBOX", "UNREAD"], "u1", (None, headers, (data,), parts))


def parse(spark, *messages, templates=None):
    df = spark.createDataFrame(list(messages), schemas.struct(schemas.MESSAGE_DDL))
    rows = extraction.parse_messages(df, AS_OF, templates).orderBy("id").collect()
    return rows[0] if len(rows) == 1 else rows


def test_direct_deposit(spark):
    row = parse(spark, message("You have a direct deposit of $1,234.56. Account ending in (...7890).", "Chase Direct Deposit"))
    assert (row.amount, row.vendor, row.account, row.template_used) == (1234.56, "Direct Deposit", "7890", "Chase Direct Deposit")
    assert row.date.isoformat() == "2025-01-02T06:33:33"


def test_small_direct_deposit(spark):
    row = parse(spark, message("You have a direct deposit of $50.00. Account ending in (...1234).", "Chase Alert: Direct Deposit"))
    assert (row.amount, row.account, row.vendor) == (50.0, "1234", "Direct Deposit")


@pytest.mark.parametrize(
    "body",
    [
        "$50.00",
        "An external transfer has been sent to John Doe on Jan 1. Card ending in 1234.",
        "<table><tr><td>Account ending in 3456</td><td>Invalid Amount</td><td>AMAZON.COM</td></tr></table>",
        "",
    ],
)
def test_no_transaction(spark, body):
    row = parse(spark, message(body))
    assert row.parse_status != "ok" and row.amount is None


def test_date_of_a_raw_cell_is_preferred_to_the_header(spark):
    body = "<p>Account ending in (...5678) You have a direct deposit of $10.00</p><td>Dec 30, 2024 at 5:07 PM ET</td>"
    assert parse(spark, message(body)).date.isoformat() == "2024-12-30T22:07:00"


def test_message_without_date_takes_the_clock(spark):
    row = parse(spark, message("A transaction of $5.00 at SHOP was approved. Visa ending in 1234", date=None))
    assert row.parse_status == "ok" and row.date_source == "as_of" and row.date.isoformat() == "2026-01-01T00:00:00"


def test_second_alternative_of_a_pattern(spark):
    body = "<p>You made a $7.25 transaction with CAFE X</p><p>Account ending in (...4321)</p><td>Dec 30, 2024 at 5:07 PM ET</td>"
    row = parse(spark, message(body, "Your $7.25 transaction with CAFE X"))
    assert (row.account, row.vendor, row.amount) == ("4321", "CAFE X", 7.25)


def test_cells_need_all_three_fields(spark):
    body = "<table><td>hello</td></table>CK 1234 deposit for $5.00 from X to CK 1234 as of Dec 30, 2024 at 5:07 PM ET"
    assert parse(spark, message(body)).template_used == "Huntington Checking/Savings Deposit"


def test_blank_first_group_is_skipped(spark):
    row = parse(spark, message("CK1234 deposit for $5.00 at  SHOP Z from branch"))
    assert (row.template_used, row.vendor) == ("Huntington Checking/Savings Deposit2", "SHOP Z")


def test_any_three_characters_before_the_account(spark):
    body = "<p>You made a $7.25 transaction with CAFE X</p><p>Chase Visa (xyz4321)</p><td>Dec 30, 2024 at 5:07 PM ET</td>"
    assert parse(spark, message(body, "Your $7.25 transaction with CAFE X")).account == "4321"


def test_vendor_from_the_subject(spark):
    only = [replace(BY_NAME["Chase Transaction Alert - New1"], vendor="(?:absent ([a-z]+) text)")]
    body = "<p>You made a $7.25 transaction</p><p>Chase Visa (...4321)</p><td>Dec 30, 2024 at 5:07 PM ET</td>"
    assert parse(spark, message(body, "Your $7.25 transaction with CAFE X"), templates=only).vendor == "CAFE X"


def test_one_broken_message_leaves_the_others(spark):
    good = message("A transaction of $5.00 at SHOP was approved. Visa ending in 1234", key="1")
    broken = ("2", "t", ["UNREAD"], "u1", None)
    bad_amount = message("A $abc external transfer to X on May 1. Account ending in 1234.", key="3")
    rows = parse(spark, good, broken, bad_amount)
    assert [r.parse_status for r in rows] == ["ok", "no_template", "extract_error"]


def test_parts_are_read_at_any_depth(spark):
    import json

    body = "A transaction of $5.00 at SHOP was approved. Visa ending in 1234"
    below = {"mimeType": "text/html", "body": {"data": encode(body)}}
    for _ in range(3):
        below = {"mimeType": "m", "parts": [{"mimeType": "text/plain", "body": {"data": encode("x")}}, below]}
    parts = [("m", (None,), [("m", (None,), [("m", (None,), json.dumps([below]))])])]
    row = parse(spark, message("", parts=parts))
    assert (row.parse_status, row.amount, row.account) == ("ok", 5.0, "1234")


def test_numeric_entities_with_leading_zeros(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import mime

    texts = ["&#0000000000065;", "&#x00000000041;", "&#99999999999999999999;x", "&#xFFFFFFFFFFFF;y", "&#65;&#x42"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(mime.unescape_entities(F.col("t")).alias("u")).collect()
    assert [r.u for r in rows] == ["A", "A", "x", "y", "AB"]


def test_group_counts():
    assert groups(r"(?s),\s*at\s+([^,]+),") == 1
    assert groups(r"(?<=ending in )[\d]{4}") == 0
    assert [t.name for t in TEMPLATES if groups(t.vendor) == 0] == ["Chase Direct Deposit"]


def test_staged_transactions_without_vendor_are_named(spark):
    df = spark.createDataFrame([message("A transaction of $5.00 at SHOP was approved. Visa ending in 1234")], schemas.struct(schemas.MESSAGE_DDL))
    table = jobs.parse_table(df, AS_OF).collect()
    assert table[0].result == "ok" and table[0].description == "SHOP"


def test_template_text_with_dollar_brace(spark):
    odd = [replace(BY_NAME["Target Credit Card"], amount=r"(?<=price \$)(\d+)", hints=("price ${",), vendor="It's")]
    row = parse(spark, message("price ${ price $12 ending in 1234"), templates=odd)
    assert (row.amount, row.vendor) == (12.0, "It's")


def test_what_a_pattern_always_captures():
    for pattern in (r"(?<=CK)(\d{4})", r"[\d]{4}", r"(?:a (\d+)|b (\d+))", r"(?:(x)y)+", r"(?s)(?<=at)(.+?)(?= on)"):
        assert always_captures(pattern), pattern
    for pattern in (r"(?<=A)(.*)(?=e)", r"(?:a (\d+)|b)", r"(x)?y", r"(?:(x)y)*", r"(([0-9,.]+)*)", r"(?=(x))", r"x*"):
        assert not always_captures(pattern), pattern


def test_an_empty_capture_is_a_match_and_a_missing_one_is_none(spark):

    may_be_empty = Template(name="a", account=r"acct (\d*);", amount=r"\$([0-9.]*) paid", vendor="V")
    two_groups = Template(name="b", account=r"(?:acct (\d{4})|card (\d{4}))", amount=r"\$(\d+)", vendor=r"(?:at (\w+)|to (\w+))", hints=("card",))
    texts = {"1": "$ paid acct ;", "2": "$12 card 9876 to SHOP", "3": "$12 card 987", "4": "nothing", "5": "$12 acct 1234 at SHOP"}
    rows = spark.createDataFrame([(k, t, "", "x") for k, t in texts.items()], "id string, sanitized_body string, raw_body string, from_addr string")
    rows = rows.selectExpr("*", "lower(sanitized_body) AS sanitized_low", "lower(raw_body) AS raw_low", "'' AS subject")
    got = {r.id: r.match for r in extraction.match_templates(rows, [may_be_empty, two_groups]).collect()}
    assert (got["1"].template, got["1"].amount_raw, got["1"].account_raw, got["1"].vendor_raw) == ("a", "", "", "V")
    assert (got["2"].template, got["2"].account_raw, got["2"].vendor_raw) == ("b", "9876", "SHOP")
    assert got["3"] is None and got["4"] is None and got["5"] is None


def test_each_pattern_is_in_the_plan_once(spark, sf):
    plan = extraction.parse_messages(views.msg(spark, sf), "2024-01-01 00:00:00")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" RLIKE ") < 60


def test_mailbox_pages(spark, sf, tmp_path):
    import json

    from ledgerloom.sources import mailbox

    path = str(tmp_path / "box")
    messages = views.msg(spark, sf)
    mailbox.write_pages(messages, f"{path}/sync=1", page=7)
    with open(f"{path}/sync=1/extra", "w") as out:  # pages without messages, blank lines, messages without columns
        out.write("\n" + json.dumps({"messages": []}) + "\n" + json.dumps({"nextPageToken": "x"}) + "\n" + json.dumps({"messages": [{"id": "odd"}]}) + "\n")
    want = {r.id for r in messages.filter("array_contains(labelIds, 'UNREAD')").collect()}
    rows = mailbox.read_mailbox(spark, path)
    assert dict(rows.dtypes) == {c: t for c, t in messages.dtypes if c in rows.columns} and rows.columns == schemas.struct(schemas.MESSAGE_DDL).names
    assert {r.id for r in rows.collect()} == want
    assert mailbox.read_mailbox(spark, path, label=None).count() == messages.count() + 1
    one = rows.filter("user_id IN ('5', '7')")
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "StringContains(labels,,UNREAD,)" in plan and "In(user_id," in plan
    assert one.count() == messages.filter("array_contains(labelIds, 'UNREAD') AND user_id IN ('5', '7')").count()
    first, second = (r.payload for r in (rows.orderBy("id").first(), messages.filter("array_contains(labelIds, 'UNREAD')").orderBy("id").first()))
    assert first == second
    assert mailbox.read_mailbox(spark, str(tmp_path / "absent")).count() == 0


def test_cells_are_read_where_the_cleaned_text_is_the_raw_one(spark):
    """Cells without closing signs are no markup, so both texts are equal; patterns are searched once then, cells still."""
    body = "<td\n>Account ending in 1234</td\n>"
    cells = [BY_NAME["Chase Credit Cards - HTML Template"]]
    row = parse(spark, message(f"{body}<td>$5.00</td><td>SHOP</td>"), templates=cells)
    assert (row.amount, row.account, row.vendor, row.body_type) == (5.0, "1234", "SHOP", "raw")
    plain = parse(spark, message("A transaction of $5.00 at SHOP was approved. Visa ending in 1234"))
    assert (plain.vendor, plain.body_type) == ("SHOP", "sanitized")


def test_fields_that_are_not_read_are_not_computed(spark, sf):
    parsed = extraction.parse_messages(views.msg(spark, sf), AS_OF)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (parsed, parsed.select("id", "template_used"))]
    header_date = "d MMM yyyy H:m:s"
    assert header_date in plans[0] and header_date not in plans[1]


def test_messages_come_in_tasks_that_grow_in_number(spark, sf, monkeypatch):
    monkeypatch.setattr(views, "MESSAGES_PER_TASK", 10)
    messages = views.msg(spark, sf)
    assert messages.rdd.getNumPartitions() >= messages.count() // 10
