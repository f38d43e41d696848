"""Messages to transactions: body, first matching template, fields, outcome.

The work is a few narrow projections. Texts are prepared once per message, and each body is searched once for the
hints of all templates. The templates are tried in registry order, so a message stops at its first match, and a
template at its first pattern that is missing; each pattern is searched once, compiled once per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, mime, text
from ..functions.staging import bound, evaluate_once
from .common import top_k_per_group
from .templates import TEMPLATES, Template, always_captures, groups

# The cleaned body is ASCII, the raw one is not: its blanks, digits and letter case follow Unicode.
_FLAGS = {"sanitized": "(?is)", "raw": "(?isUd)"}
HINTS_PER_MASK = 20  # templates whose hints share a mask of 64 bits; a template has three at most
_MATCH_DDL = (
    "struct<template: string, body_type: string, amount_raw: string, account_raw: string, vendor_raw: string, "
    "date_raw: string>"
)


def with_bodies(messages: DataFrame) -> DataFrame:
    """Headers, ids and both forms of the body."""
    payload, headers = F.col("payload"), F.col("payload.headers")
    staged = evaluate_once(
        messages.withColumn("leaves", mime.leaf_parts(payload)),
        {
            "subject": F.coalesce(text.header(headers, "Subject"), F.lit("")),
            "from_addr": F.coalesce(text.header(headers, "From"), F.lit("")),
            "date_header": text.header(headers, "Date"),
            "message_id": text.message_id(headers, F.col("id")),
            "raw_body": mime.raw_body(payload, F.col("leaves")),
        },
    )
    staged = mime.sanitize_into(staged, "raw_body", "sanitized_body")
    return evaluate_once(
        staged,
        {
            "sanitized_low": F.lower("sanitized_body"),
            # cleaned text is printable ASCII with line feeds, on which both sets of flags find the same: searched once if equal
            "raw_low": F.when(F.col("raw_body") != F.col("sanitized_body"), F.lower("raw_body")),
        },
    )


# ----------------------------------------------------------------------------------------- table cells


def cell_texts(body: Column) -> Column:
    """Non-blank texts of all table cells, in order.

    The body is split at cell starts, each piece ends at its own cell end. One pattern over the whole table
    would swallow neighbouring cells."""
    pieces = F.filter(F.split(body, r"(?i)<td\b[^>]*>"), lambda _, i: i > 0)
    inner = F.transform(pieces, lambda p: text.strip(F.regexp_replace(F.split(p, r"(?i)</td>", 2)[0], "<[^>]*>", "")))
    found = F.filter(inner, lambda x: x != "")
    return F.when(F.lower(body).contains("<td"), found).otherwise(F.array().cast("array<string>"))


def cell_fields(cells: Column) -> dict[str, Column]:
    """Account from the last ``ending in`` cell, amount from the last ``$`` cell, vendor from the last cell
    that is no label."""
    is_account = lambda c: F.lower(c).contains("ending in")
    is_amount = lambda c: ~is_account(c) & c.contains("$")
    label = lambda c: reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in ("account", "amount", "merchant", "posted")])
    is_vendor = lambda c: ~is_account(c) & ~c.contains("$") & ~label(c)
    last = lambda keep: F.try_element_at(F.filter(cells, keep), F.lit(-1))
    return {
        "account": F.try_element_at(F.split(last(is_account), r"\s+"), F.lit(-1)),
        "amount": last(is_amount),
        "vendor": last(is_vendor),
    }


# ------------------------------------------------------------------------------------------- templates


def first_group(body: str, pattern: str, flags: str, trim: bool = False) -> str:
    """First non-empty group of the first occurrence, or the whole match of a pattern without groups; the empty text
    where nothing is found or nothing is captured."""
    full, n = text.quoted(flags + pattern), groups(pattern)
    parts = [f"regexp_extract({body}, {full}, {i})" for i in (range(1, n + 1) if n else [0])]
    if trim:
        parts = [f"btrim({part}, {text.quoted(text.BLANKS)})" for part in parts]
    return parts[0] if len(parts) == 1 else f"coalesce(get(filter(array({', '.join(parts)}), g -> g <> ''), 0), '')"


def _bound(name: str, value: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` stands for ``value``, computed once and only when it is asked for."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _found(name: str, column: str, pattern: str, flags: str, inner: str) -> str:
    """``inner`` if the pattern occurs, with its text as ``name``; NULL otherwise. One search, unless the pattern can
    occur and capture nothing."""
    if always_captures(pattern):
        return _bound(name, first_group(column, pattern, flags), f"CASE WHEN {name} <> '' THEN {inner} END")
    return f"CASE WHEN {column} RLIKE {text.quoted(flags + pattern)} THEN {_bound(name, first_group(column, pattern, flags), inner)} END"


def _hint_bits(templates: list[Template]) -> dict[str, int]:
    """A bit for each different hint."""
    return {hint: i for i, hint in enumerate(dict.fromkeys(h for t in templates for h in t.hints))}


def _hint_mask(low: str, bits: dict[str, int]) -> Column:
    """The bits of the hints that a lower-case text contains; each hint is looked for once."""
    parts = [f"CASE WHEN contains({low}, {text.quoted(h)}) THEN {1 << i}L ELSE 0L END" for h, i in bits.items()]
    return F.expr(" | ".join(parts) or "0L")


def _candidate(template: Template, kind: str, need_date: bool, bits: dict[str, int]) -> Column:
    """The match of one template on one form of the body, NULL if it does not fit. Tests run from cheap to costly, and
    the first that fails ends them."""
    body, flags = f"{kind}_body", _FLAGS[kind]
    gates = []
    if template.email_from:
        gates.append(f"from_addr = {text.quoted(template.email_from)}")
    if kind == "raw" and not template.cells:
        gates.append("raw_low IS NOT NULL")
    if template.hints:
        hints = "CASE WHEN raw_low IS NULL THEN sanitized_hints ELSE raw_hints END" if template.cells else f"{kind}_hints"
        gates.append(f"({hints} & {sum(1 << bits[h] for h in template.hints)}L) <> 0")
    if template.subject_pattern:
        gates.append(f"subject RLIKE {text.quoted(_FLAGS['raw'] + template.subject_pattern)}")
    gate = " AND ".join(gates)
    if template.cells:
        found = _cell_match(template, kind)
        return F.when(F.expr(gate), found) if gate else found
    out = (
        f"named_struct('template', {text.quoted(template.name)}, 'body_type', '{kind}', 'amount_raw', a, "
        f"'account_raw', btrim(c, {text.quoted(text.BLANKS)}), 'vendor_raw', v, 'date_raw', d)"
    )
    # from the innermost: date, vendor, account, amount
    if not template.date:
        out = _bound("d", "CAST(NULL AS STRING)", out)
    elif need_date and always_captures(template.date):
        out = _found("d", body, template.date, flags, out)
    else:
        out = _bound("d", f"nullif({first_group(body, template.date, flags)}, '')", out)
        if need_date:
            out = f"CASE WHEN {body} RLIKE {text.quoted(flags + template.date)} THEN {out} END"
    if template.vendor_is_pattern:
        vendor = first_group(body, template.vendor, flags, trim=True)
        if template.subject_vendor:
            subject = first_group("subject", template.subject_vendor, _FLAGS["raw"], trim=True)
            vendor = _bound("w", vendor, f"CASE WHEN w <> '' THEN w ELSE {subject} END")
        out = _bound("v", vendor, f"CASE WHEN v <> '' THEN {out} END")
    else:
        out = _bound("v", text.quoted(template.vendor), out)
    out = _found("c", body, template.account, flags, out)
    out = _found("a", body, template.amount, flags, out)
    return F.expr(f"CASE WHEN {gate} THEN {out} END" if gate else out)


def _cell_match(template: Template, kind: str) -> Column:
    """The match by table cells, which are taken from the body only here."""

    def match(cell: Column) -> Column:
        fields = {"template": F.lit(template.name), "body_type": F.lit(kind), "amount_raw": cell["amount"],
                  "account_raw": text.strip(cell["account"]), "vendor_raw": cell["vendor"], "date_raw": F.lit(None).cast("string")}
        whole = (cell["amount"] != "") & (cell["account"] != "") & (cell["vendor"] != "")
        return F.when(whole, F.struct(*[c.alias(n) for n, c in fields.items()]))

    def of_cells(cells: Column) -> Column:
        return bound(F.struct(*[c.alias(n) for n, c in cell_fields(cells).items()]), match)

    return bound(cell_texts(F.col(f"{kind}_body")), of_cells)


def first_match(templates: list[Template], bits: dict[str, int] | None = None) -> Column:
    """First template in order, tried on the cleaned and then on the raw body. A template whose date is
    optional is tried with its date on both forms before it is tried without. Needs the ``_hints`` of both bodies."""
    bits = _hint_bits(templates) if bits is None else bits
    candidates = []
    for template in templates:
        kinds = ("raw",) if template.cells else ("sanitized", "raw")
        tries = [(kind, True) for kind in kinds] + [(kind, False) for kind in kinds if template.date_optional]
        candidates += [_candidate(template, kind, need_date, bits) for kind, need_date in tries]
    return F.coalesce(*candidates).cast(_MATCH_DDL)


def match_templates(bodies: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """Append ``match``. Each body is searched once for all hints, which decide by bits what templates are tried; a
    template's patterns are each looked for once and bound by name, up to the first that is missing."""
    templates = templates or TEMPLATES
    out = bodies
    for i in range(0, len(templates), HINTS_PER_MASK):
        some = templates[i : i + HINTS_PER_MASK]
        bits = _hint_bits(some)
        out = evaluate_once(out, {f"{kind}_hints": _hint_mask(f"{kind}_low", bits) for kind in _FLAGS})
        step = first_match(some, bits)
        out = evaluate_once(out, {"match": step if not i else F.when(F.col("match").isNull(), step).otherwise(F.col("match"))})
    return out


def parse_messages(
    messages: DataFrame, as_of, templates: list[Template] | None = None, default_zone: str = "UTC"
) -> DataFrame:
    """One row per message: transaction fields and ``parse_status`` (ok, no_template, extract_error).
    A broken message never affects another one."""
    bodies = with_bodies(messages)
    keep = [c for c in messages.columns if c not in ("payload",)]
    matched = match_templates(bodies.drop("payload"), templates).select(
        *keep, "message_id", "subject", "from_addr", "date_header", "match"
    )
    return extract_fields(matched, as_of, default_zone)


def extract_fields(matched: DataFrame, as_of, default_zone: str = "UTC") -> DataFrame:
    """Typed fields of a match. A message without a usable date takes the header's, then ``as_of``."""
    from_text = dates.parse_date(F.col("match.date_raw"), F.col("date_header"), default_zone)
    from_header = dates.header_instant(F.col("date_header"), default_zone)
    fielded = matched.withColumns(
        {
            "template_used": F.col("match.template"),
            "body_type": F.col("match.body_type"),
            "amount": text.parse_amount(F.col("match.amount_raw")),
            "account": F.col("match.account_raw"),
            "vendor": text.strip(F.col("match.vendor_raw")),
            "text_date": from_text,
            "sent_date": from_header,
        }
    ).drop("match")
    status = (
        F.when(F.col("template_used").isNull(), "no_template")
        .when(F.col("amount").isNull() | (F.col("account").isNull() & F.col("vendor").isNull()), "extract_error")
        .otherwise("ok")
    )
    source = F.when(F.col("text_date").isNotNull(), "text").when(F.col("sent_date").isNotNull(), "header").otherwise("as_of")
    out = fielded.withColumns(
        {
            "parse_status": status,
            "date": F.coalesce("text_date", "sent_date", dates.as_clock(as_of)),
            "date_source": source,
        }
    ).drop("text_date", "sent_date")
    return out  # plain projections, so that fields which a job does not read are not computed


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions, and the quarantine with a reason."""
    ok = parsed.filter(F.col("parse_status") == "ok")
    bad = parsed.filter(F.col("parse_status") != "ok").withColumn("reason", F.col("parse_status"))
    return ok, bad


# -------------------------------------------------------------------------------------------- coverage


def template_samples(parsed: DataFrame, order: str = "message_id") -> DataFrame:
    """One complete transaction per template: all fields present and a four-digit account."""
    complete = parsed.filter(
        (F.col("parse_status") == "ok")
        & (F.col("amount") != 0)
        & (F.col("vendor") != "")
        & text.is_four_digits(F.col("account"))
    )
    row = F.min_by(F.struct(order, "from_addr", "vendor", "amount", "account"), F.col(order)).alias("row")
    return complete.groupBy("template_used").agg(row).select("template_used", "row.*")


def unmatched_senders(parsed: DataFrame, per_user: int = 2, order: str = "message_id") -> DataFrame:
    """Up to ``per_user`` messages without a template per user, leaving out senders that matched before."""
    known = parsed.filter(F.col("template_used").isNotNull()).select("from_addr").distinct()
    open_rows = parsed.filter(F.col("template_used").isNull()).join(known, "from_addr", "left_anti")
    return top_k_per_group(open_rows, ["user_id"], [F.col(order)], per_user, F.col(order))


def missing_templates(parsed: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Names in the registry that no message used."""
    names = names or [t.name for t in TEMPLATES]
    registry = parsed.sparkSession.createDataFrame([(n,) for n in names], "template_used STRING")
    used = parsed.filter(F.col("template_used").isNotNull()).select("template_used").distinct()
    return registry.join(used, "template_used", "left_anti")


def merge_samples(old: DataFrame, new: DataFrame, key: str = "template_used") -> DataFrame:
    """Keyed union in which the new entry wins."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
