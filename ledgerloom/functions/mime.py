"""Message bodies: base64url, quoted-printable and HTML clean-up as native column expressions."""

from __future__ import annotations

import json
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import evaluate_once
from .text import blank_to_null, literal_map, strip

# ---------------------------------------------------------------------------------------------------------
# transfer encodings


def joined_data(data: Column) -> Column:
    """Body data is base64 text, or a JSON list of such texts whose non-blank elements are joined."""
    items = F.from_json(data, "array<string>")
    joined = F.array_join(F.filter(items, lambda x: F.trim(x) != ""), "")
    return F.when(F.startswith(data, F.lit("[")), joined).otherwise(data)


def decode_base64url(data: Column) -> Column:
    """Decode to text. Broken input gives NULL, bytes that are not UTF-8 become U+FFFD."""
    # byte searches: ``translate`` looks each character up in a map
    text = F.replace(F.replace(data, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    text = F.replace(F.replace(text, F.lit("\r")), F.lit("\n"))
    # characters outside the alphabet are skipped; the search for them runs only where the plain way fails
    clean = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    decoded = F.coalesce(F.try_to_binary(text, F.lit("base64")), F.try_to_binary(clean, F.lit("base64")))
    return F.make_valid_utf8(decoded.cast("string"))


def decode_quoted_printable(text: Column) -> Column:
    """Soft line breaks and ``=XX`` bytes.

    The bytes are decoded by rewriting ``=XX`` as ``%XX`` and using the URL decoder, which turns a run of
    bytes into UTF-8 text; a literal ``%`` or ``+`` is escaped first. No Python worker is needed.
    """
    escaped = F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    escaped = F.replace(escaped, F.lit("=="), F.lit("%3D"))
    unfolded = F.regexp_replace(escaped, r"=(?:\r[^\n]*)?\n|=\z", "")
    return F.when(
        text.rlike(r"=(?:[0-9A-Fa-f]{2}|[\r\n=]|\z)"), F.try_url_decode(F.regexp_replace(unfolded, "=([0-9A-Fa-f]{2})", "%$1"))
    ).otherwise(text)


# ---------------------------------------------------------------------------------------------------------
# HTML

# Only entities for printable ASCII or a line feed survive the clean-up below, so only those are looked up;
# every other one is dropped. Both tables come from the Python standard library when the plan is built.
_NAMED = {
    name[:-1]: value
    for name, value in html5.items()
    if name.endswith(";") and all(0x20 <= ord(ch) <= 0x7E or ch == "\n" for ch in value)
}
_BARE = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)


def _short(digits: Column) -> Column:
    """The digits without leading zeros, or NULL when there are too many for any character."""
    significant = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(significant) <= 7, significant)


def _code_point(number: Column) -> Column:
    keep = number.between(0x20, 0x7E) | (number == 10)
    return F.when(F.coalesce(keep, F.lit(False)), F.chr(number)).otherwise(F.lit(""))


def unescape_entities(text: Column) -> Column:
    """Decode entities in one pass: the text is split at ``&`` and each piece starts with an entity or not."""
    named = literal_map(_NAMED)
    bare = "^(" + "|".join(_BARE) + ")"

    def decode(piece: Column, index: Column) -> Column:
        dec = F.regexp_extract(piece, "^#([0-9]+);?", 1)
        hexa = F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+);?", 1)
        name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1)
        prefix = F.regexp_extract(piece, bare, 1)
        return (
            F.when(index == 0, piece)
            .when(dec != "", F.concat(_code_point(_short(dec).cast("int")), F.regexp_replace(piece, "^#[0-9]+;?", "")))
            .when(
                hexa != "",
                F.concat(
                    _code_point(F.conv(_short(hexa), 16, 10).cast("int")), F.regexp_replace(piece, "^#[xX][0-9a-fA-F]+;?", "")
                ),
            )
            .when(
                name != "",
                F.concat(
                    F.coalesce(F.try_element_at(named, name), F.lit("")), F.regexp_replace(piece, "^[^;]*;", "")
                ),
            )
            .when(
                prefix != "",
                F.concat(
                    F.coalesce(F.try_element_at(named, prefix), F.lit("")), F.substr(piece, F.length(prefix) + 1)
                ),
            )
            .otherwise(F.concat(F.lit("&"), piece))
        )

    decoded = F.array_join(F.transform(F.split(text, "&"), decode), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def strip_markup(text: Column) -> Column:
    """Drop scripts, styles and comments with their content, turn other tags into blanks, collapse blanks."""
    bare = F.regexp_replace(text, r"(?is)<script[^>]*>.*?</script>", "")
    bare = F.regexp_replace(bare, r"(?is)<style[^>]*>.*?</style>", "")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    return F.regexp_replace(F.when(text.contains("<"), bare).otherwise(text), r"(?U)[\s\x1c-\x1f]+", " ")


def tidy(text: Column) -> Column:
    """Drop leftover entities and everything but printable ASCII and line feeds, then trim."""
    text = F.regexp_replace(text, r"&[a-zA-Z0-9#]+;", "")
    return strip(F.regexp_replace(text, r"[^\x20-\x7E\n]", ""))


def sanitize_into(df: DataFrame, source: str, target: str) -> DataFrame:
    """Append the readable ASCII text of an HTML body. Entities are decoded after blanks collapse, so
    ``&nbsp;`` vanishes. Done in steps, because each later step looks at its input more than once."""
    df = evaluate_once(df, {"_qp": decode_quoted_printable(F.coalesce(F.col(source), F.lit("")))})
    df = evaluate_once(df, {"_text": strip_markup(F.col("_qp"))}).drop("_qp")
    return evaluate_once(df, {target: tidy(unescape_entities(F.col("_text")))}).drop("_text")


# ---------------------------------------------------------------------------------------------------------
# parts


def _leaf(part: Column) -> Column:
    return F.struct(part["mimeType"].alias("mime"), part["body"]["data"].alias("data"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("mime", T.StringType()), T.StructField("data", T.StringType())])))
def _deep_leaves(payloads: pd.Series) -> pd.Series:
    """Leaves of part trees given as JSON, depth first; NULL stays NULL. Parts that are text again are read on."""

    def walk(text: str | None) -> list[dict] | None:
        if text is None:
            return None
        waiting, out = [json.loads(text)], []
        while waiting:
            part = waiting.pop()
            if not isinstance(part, dict):
                continue
            below = part.get("parts")
            if isinstance(below, str):
                try:
                    below = json.loads(below)
                except ValueError:
                    below = None
            if isinstance(below, list):
                waiting += reversed(below)
            else:
                body = part.get("body")
                out.append({"mime": part.get("mimeType"), "data": body.get("data") if isinstance(body, dict) else None})
        return out

    return payloads.map(walk)


def leaf_parts(payload: Column) -> Column:
    """Leaves of the part tree, depth first, as an array of (mime, data). Three levels are typed; a deeper tree, which
    messages hardly have, is walked from its JSON by an Arrow function that gets NULL for all others."""
    deeper = F.when(has_deeper_parts(payload), F.to_json(payload))
    return F.coalesce(_deep_leaves(deeper), _typed_leaves(payload))


def _typed_leaves(payload: Column) -> Column:

    def leaves(part: Column, depth: int) -> Column:
        if depth == 0:
            return F.array(_leaf(part))
        below = F.flatten(F.transform(part["parts"], lambda p: leaves(p, depth - 1)))
        return F.when(part["parts"].isNotNull(), below).otherwise(F.array(_leaf(part)))

    return leaves(payload, 3)


def has_deeper_parts(payload: Column) -> Column:
    """True when a part below the third typed level exists."""
    deep = F.exists(
        payload["parts"],
        lambda a: F.exists(a["parts"], lambda b: F.exists(b["parts"], lambda c: c["parts"].isNotNull())),
    )
    return F.coalesce(deep, F.lit(False))


def raw_body(payload: Column, leaves: Column) -> Column:
    """All HTML leaves (see ``leaf_parts``) joined by a blank line; else the top-level body; else the first plain top-level part."""
    html = F.filter(leaves, lambda p: (p["mime"] == "text/html") & (p["data"] != ""))
    decoded = F.filter(F.transform(html, lambda p: decode_base64url(joined_data(p["data"]))), lambda x: x.isNotNull())
    plain = F.filter(payload["parts"], lambda p: (p["mimeType"] == "text/plain") & (p["body"]["data"] != ""))
    plain = F.filter(
        F.transform(plain, lambda p: decode_base64url(joined_data(p["body"]["data"]))), lambda x: x.isNotNull()
    )
    top = blank_to_null(payload["body"]["data"])
    return F.coalesce(
        F.when(F.size(decoded) > 0, F.array_join(decoded, "\n\n")),
        F.when(top.isNotNull(), F.coalesce(decode_base64url(joined_data(top)), F.lit(""))),
        F.get(plain, F.lit(0)),
        F.lit(""),
    )
