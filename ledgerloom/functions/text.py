"""Text expressions: headers, vendor names, keys and model names. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\x0b"

# Vendor substrings and the count column each one feeds, in order.
VENDOR_PATTERNS = [
    ("amz", "amazon"),
    ("a.mazon", "amazon"),
    ("amazon", "amazon"),
    ("aramark", "aramark"),
    ("jpmc", "aramark"),
    ("great clips", "great_clips"),
    ("osu", "ohio_state"),
    ("ohio state", "ohio_state"),
    ("firstma", "student_loan"),
    ("mohela", "student_loan"),
    ("spirits", "bar"),
    ("brewery", "bar"),
    ("tavern", "bar"),
    ("bar", "bar"),
    ("supplement", "supplements"),
    ("best buy", "best_buy"),
    ("lending", "loan"),
]

# Order of the pattern count columns in a feature row.
VENDOR_FLAGS = [
    "amazon", "aramark", "great_clips", "ohio_state", "student_loan", "bar", "supplements", "best_buy", "loan",
]


def quoted(value: str) -> str:
    """A SQL text literal. Long fixed expressions are written as SQL text: one call builds them, where
    column objects would take one call to the JVM per node."""
    value = value.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + value.replace("${", "\\u0024{") + "'"  # ${...} would be taken for a variable


def literal_map(mapping: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(quoted(x) for pair in mapping.items() for x in pair) + ")")


def literal_array(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(quoted(v) for v in values) + ")")


def strip(text: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(text, F.lit(BLANKS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def header(headers: Column, name: str) -> Column:
    """Value of a header by exact name; of duplicates the last wins."""
    return F.try_element_at(F.filter(headers, lambda h: h["name"] == name), F.lit(-1))["value"]


def message_id(headers: Column, mailbox_id: Column) -> Column:
    """The Message-ID header in any letter case without its angle brackets, else the mailbox id."""
    first = F.get(F.filter(headers, lambda h: F.lower(h["name"]) == "message-id"), F.lit(0))["value"]
    return F.coalesce(strip(F.btrim(first, F.lit("<>"))), mailbox_id)


def clean_vendor(vendor: Column, default: str = "") -> Column:
    """Lower case, runs of anything but letters become one blank, trimmed; empty or NULL gives ``default``."""
    cleaned = F.trim(F.regexp_replace(F.lower(vendor), "[^a-z]+", " "))
    return F.coalesce(blank_to_null(cleaned), F.lit(default))


def vendor_pattern_counts(vendor: Column) -> dict[str, Column]:
    """Per flag, how many of its substrings occur in the vendor (a count, not 0/1)."""
    low = F.lower(F.coalesce(vendor, F.lit("")))
    counts = {}
    for flag in VENDOR_FLAGS:
        hits = [low.contains(text).cast("int") for text, name in VENDOR_PATTERNS if name == flag]
        counts[flag] = reduce(lambda a, b: a + b, hits)
    return counts


def simple_phonetic(text: Column) -> Column:
    """Stand-in phonetic code: upper case, letters only."""
    return F.regexp_replace(F.upper(text), "[^A-Z]", "")


def infer_template(account: Column) -> Column:
    """Template name guessed from the account text."""
    low = F.lower(F.coalesce(account.cast("string"), F.lit("")))
    return (
        F.when(low.contains("credit"), "CREDIT_CARD_TEMPLATE")
        .when(low.contains("checking"), "BANK_TEMPLATE_A")
        .when(low.contains("savings"), "BANK_TEMPLATE_B")
        .otherwise("GENERIC_TEMPLATE")
    )


def score_key(vendor: Column, description: Column, amount: Column, template: Column) -> Column:
    """Key under which two rows count as the same for scoring: vendor|amount|template, lower case."""
    return F.lower(
        F.concat_ws(
            "|",
            F.coalesce(vendor, description, F.lit("")),
            F.coalesce(amount, F.lit(0.0)).cast("string"),
            F.coalesce(template, F.lit("")),
        )
    )


def is_four_digits(account: Column) -> Column:
    return F.coalesce(account.rlike(r"^\d{4}$"), F.lit(False))


def model_number(name: Column) -> Column:
    """``transaction_model_v12`` -> 12; a name without a number gives NULL."""
    return F.try_element_at(F.split(name, "_v"), F.lit(-1)).try_cast("int")


def parse_amount(text: Column) -> Column:
    """``$1,234.50`` -> 1234.5; parentheses mean a negative amount; anything else gives NULL."""
    number = strip(F.regexp_replace(text, "[$,()]", "")).try_cast("double")
    negative = text.contains("(") & text.contains(")")
    return F.when(negative, -number).otherwise(number)
