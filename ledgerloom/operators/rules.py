"""Projections, row gates and validation of ledger rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.phonetic import primary_code
from .common import require_columns

UNCATEGORIZED = "Uncategorized"

# Order of the text columns in a feature row.
FEATURE_TEXT = [
    "vendor", "vendor_cleaned", "cleaned_metaphone", "template_used", "account", "day", "month", "year", "day_name",
]

# Columns of the prepared training set, in order.
ML_COLUMNS = [
    "transaction_id", "user_id", "vendor", "vendor_cleaned", "cleaned_metaphone", "amount", "account",
    "template_used", "date", "day", "month", "year", "day_name", "category", "subcategory", "is_user_corrected",
    "user_category", "user_subcategory", "predicted_category", "predicted_subcategory",
]

# Keys every row of an ingest request carries.
INGEST_KEYS = ["id", "vendor", "amount", "date", "account", "template_used"]


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


# ------------------------------------------------------------------------------------------------ labels


def resolve_label(user: Column, predicted: Column, blank_is_null: bool = True) -> Column:
    """User label over prediction over ``Uncategorized``; a prediction of ``Uncategorized`` counts as missing.

    ``blank_is_null`` is the export form, where empty text is missing too; the preparation form keeps it."""
    predicted = F.nullif(predicted, F.lit(UNCATEGORIZED))
    if blank_is_null:
        user, predicted = text.blank_to_null(user), text.blank_to_null(predicted)
    return F.coalesce(user, predicted, F.lit(UNCATEGORIZED))


def resolve_labels(df: DataFrame, blank_is_null: bool = True) -> DataFrame:
    """Append ``category`` and ``subcategory``. Without a user column the prediction is copied as it is;
    with neither, an existing label stays and a missing one becomes ``Uncategorized``."""
    out = {}
    for name in ("category", "subcategory"):
        user, predicted = f"user_{name}", f"predicted_{name}"
        if user in df.columns:
            out[name] = resolve_label(F.col(user), _col(df, predicted), blank_is_null)
        else:
            source = predicted if predicted in df.columns else name
            out[name] = F.coalesce(_col(df, source), F.lit(UNCATEGORIZED))
    return df.withColumns(out)


def corrected_by_export(df: DataFrame) -> Column:
    """A non-empty user label, or the stored flag."""
    labelled = text.blank_to_null(_col(df, "user_category")).isNotNull() | text.blank_to_null(
        _col(df, "user_subcategory")
    ).isNotNull()
    return labelled | F.coalesce(_col(df, "user_corrected", "boolean"), F.lit(False))


def corrected_by_preparation(df: DataFrame) -> Column:
    """A user label that is not NULL, else the ``corrected`` key of the feedback JSON, else false."""
    if "user_category" in df.columns or "user_subcategory" in df.columns:
        return _col(df, "user_category").isNotNull() | _col(df, "user_subcategory").isNotNull()
    if "user_feedback" in df.columns:
        flag = F.get_json_object("user_feedback", "$.corrected").try_cast("boolean")
        return F.coalesce(flag, F.lit(False))
    return F.lit(False)


def override_fields(df: DataFrame) -> DataFrame:
    """Vendor from the user, else from the row, else from the description, else ``Unknown``; account from
    ``account_id`` when there is no account column."""
    if "vendor" in df.columns:
        vendor = F.coalesce(_col(df, "user_vendor"), F.col("vendor"))
    else:
        vendor = _col(df, "description") if "description" in df.columns else F.lit("Unknown")
    account = F.col("account") if "account" in df.columns else _col(df, "account_id")
    return df.withColumns({"vendor": vendor, "account": account})


# ---------------------------------------------------------------------------------------------- features


def feature_rows(df: DataFrame, as_of, keep: list[str] | None = None) -> DataFrame:
    """The 18 model features in their fixed order (9 texts, 9 counts) behind the ``keep`` columns."""
    clock = dates.as_clock(as_of)
    if "vendor" in df.columns:
        vendor = F.col("vendor")
    else:
        vendor = F.col("description") if "description" in df.columns else F.lit("Unknown")
    df = df.withColumns({"vendor": vendor, "vendor_cleaned": text.clean_vendor(vendor)})
    parts = dates.date_features(_col(df, "date", "timestamp_ntz"), clock)
    low = F.lower(F.coalesce(F.col("vendor"), F.lit("")))
    texts = {
        "vendor": low,
        "vendor_cleaned": F.col("vendor_cleaned"),
        "cleaned_metaphone": primary_code(F.col("vendor_cleaned")),
        "template_used": F.coalesce(_col(df, "template_used"), F.lit("")),
        "account": F.coalesce(_col(df, "account"), F.lit("")),
        **{name: col.cast("string") for name, col in parts.items()},
    }
    counts = text.vendor_pattern_counts(F.col("vendor"))
    return df.select(
        *(keep or []),
        *[texts[name].alias(name) for name in FEATURE_TEXT],
        *[counts[name].alias(name) for name in text.VENDOR_FLAGS],
    )


def prepare_training_rows(df: DataFrame) -> DataFrame:
    """Ledger or warehouse rows to the labelled training layout. Columns that exist are kept, missing ones
    are derived; a frame without amount, account or date is refused."""
    df = override_fields(resolve_labels(df, blank_is_null=False))
    require_columns(df, ["vendor", "amount", "account", "date", "category", "subcategory"])
    added = {}
    if "vendor_cleaned" not in df.columns:
        df = df.withColumn("vendor_cleaned", text.clean_vendor(F.col("vendor")))
    if "cleaned_metaphone" not in df.columns:
        added["cleaned_metaphone"] = primary_code(F.col("vendor_cleaned"))
    if "template_used" not in df.columns:
        added["template_used"] = text.infer_template(F.col("account"))
    if "is_user_corrected" not in df.columns:
        added["is_user_corrected"] = corrected_by_preparation(df)
    if "user_id" not in df.columns:
        added["user_id"] = F.lit("unknown")
    df = df.withColumns({**added, **dates.date_parts(F.col("date"))})
    return df.select(*[c for c in ML_COLUMNS if c in df.columns])


# -------------------------------------------------------------------------------------------- validation


def validation_errors(df: DataFrame) -> Column:
    """Array of messages for a ledger row whose fields are still texts; empty means valid.

    Amount is a number in text or numeric form; a NULL field is a missing field."""
    amount = F.col("amount").try_cast("double")
    checks = [
        *[(F.col(c).isNull(), f"Missing required field: {c}") for c in
          ("id", "date", "description", "amount", "account_id", "user_id") if c in df.columns],
        *[(F.lit(True), f"Missing required field: {c}") for c in
          ("id", "date", "description", "amount", "account_id", "user_id") if c not in df.columns],
    ]
    if "date" in df.columns:
        checks.append((F.col("date").isNotNull() & ~dates.is_iso(F.col("date").cast("string")), "Invalid date format"))
    if "amount" in df.columns:
        checks.append((F.col("amount").isNotNull() & amount.isNull(), "Invalid amount value"))
        checks.append((amount == 0, "Amount cannot be zero"))
    if "description" in df.columns:
        checks.append((text.strip(F.col("description")) == "", "Description cannot be empty"))
    if "user_id" in df.columns:
        checks.append((text.strip(F.col("user_id")) == "", "User ID cannot be empty"))
    return F.filter(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in checks]), lambda e: e.isNotNull())


def type_errors(df: DataFrame) -> list[str]:
    """Columns whose type cannot hold the field at all; found in the schema when the plan is built."""
    wanted = {
        "id": "string", "description": "string", "account_id": "string", "user_id": "string", "category": "string",
        "notes": "string", "vendor": "string", "location": "string", "tags": "array",
    }
    found = dict(df.dtypes)
    return [
        f"Invalid type for {name}: expected {kind}, got {found[name]}"
        for name, kind in wanted.items()
        if name in found and not found[name].startswith(kind)
    ]


def is_writable(df: DataFrame) -> Column:
    """The ledger write gate: amount not 0, vendor, account and template not empty, and some id."""
    filled = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("vendor", "account", "template_used")]
    some_id = F.coalesce(_col(df, "id") != "", F.lit(False)) | F.coalesce(_col(df, "id_api") != "", F.lit(False))
    return reduce(lambda a, b: a & b, filled) & F.coalesce(F.col("amount") != 0, F.lit(False)) & some_id


def document_key(df: DataFrame) -> Column:
    return F.coalesce(text.blank_to_null(_col(df, "id")), _col(df, "id_api"))


def accept_requests(rows: DataFrame, request: str = "request_id", keys: list[str] | None = None) -> DataFrame:
    """Ingest gate: every row needs a user and all keys, and one bad row rejects its whole request.

    Rejected requests come from an aggregate (only bad rows are shuffled), then an anti join drops them; a
    request of any size never has to fit in one task."""
    keys = keys or INGEST_KEYS
    filled = F.coalesce(F.col("user_id") != "", F.lit(False))
    ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], filled)
    bad = rows.filter(~ok).select(request).distinct()
    return rows.join(bad, request, "left_anti")


def ingest_errors(rows: DataFrame, request: str = "request_id", keys: list[str] | None = None) -> DataFrame:
    """One row per rejected request with the first row at fault and its missing fields."""
    keys = keys or INGEST_KEYS
    missing = F.filter(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in keys]), lambda x: x.isNotNull())
    no_user = ~F.coalesce(F.col("user_id") != "", F.lit(False))
    message = F.when(no_user, F.lit("Missing required field: user_id")).otherwise(
        F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))
    )
    return (
        rows.withColumn("_missing", missing)
        .filter(no_user | (F.size("_missing") > 0))
        .groupBy(request)
        .agg(F.min(F.struct(F.col("row_index"), message.alias("error"))).alias("first"))
        .select(request, F.col("first.row_index").alias("row_index"), F.col("first.error").alias("error"))
    )


def is_scorable(df: DataFrame) -> Column:
    """Scoring gate: a vendor or description, and an amount."""
    named = F.coalesce(_col(df, "vendor") != "", F.lit(False)) | F.coalesce(_col(df, "description") != "", F.lit(False))
    return named & _col(df, "amount", "double").isNotNull()


def default_prediction(source: str = "unavailable") -> dict[str, Column]:
    """Prediction given to rows that were not scored."""
    return {
        "category": F.lit(UNCATEGORIZED),
        "subcategory": F.lit(None).cast("string"),
        "confidence": F.lit(0.0),
        "model_version": F.lit(None).cast("string"),
        "source": F.lit(source),
    }


def fill_default_prediction(scored: DataFrame, source: str = "unavailable") -> DataFrame:
    """Defaults where a scored row has no category."""
    defaults = default_prediction(source)
    missing = F.col("category").isNull()
    return scored.withColumns({n: F.when(missing, d).otherwise(F.col(n)) for n, d in defaults.items()})


def apply_prediction(df: DataFrame) -> DataFrame:
    """Copy a prediction to the ledger fields, but only when it names a category."""
    use = F.coalesce(F.col("category") != UNCATEGORIZED, F.lit(False))
    return df.withColumns(
        {
            "predicted_category": F.when(use, F.col("category")).otherwise(F.lit(UNCATEGORIZED)),
            "predicted_subcategory": F.when(use, F.col("subcategory")),
            "prediction_confidence": F.when(use, F.coalesce("confidence", F.lit(0.0))).otherwise(F.lit(0.0)),
            "model_version": F.when(use, F.col("model_version")),
        }
    )


def enabled_users(users: DataFrame, email: str = "contactInformation._email") -> DataFrame:
    """Users with e-mail sync switched on and an address."""
    return users.filter(F.coalesce("email_sync_enabled", F.lit(False)) & (F.coalesce(F.col(email), F.lit("")) != ""))


def row_defaults(df: DataFrame) -> DataFrame:
    """Old field names to new ones and a description for every row."""
    out = {}
    if "vendor" in df.columns or "merchant" in df.columns:
        out["vendor"] = F.coalesce(text.blank_to_null(_col(df, "vendor")), _col(df, "merchant"))
    # the description looks at the vendor as it came in, before the old field name is mapped
    out["description"] = F.coalesce(
        text.blank_to_null(_col(df, "description")), text.blank_to_null(_col(df, "vendor")), F.lit("Unknown transaction")
    )
    out["predicted_category"] = F.coalesce(
        text.blank_to_null(_col(df, "predicted_category")), _col(df, "category"), F.lit(UNCATEGORIZED)
    )
    out["last_modified"] = F.coalesce(
        _col(df, "last_modified", "timestamp_ntz"), _col(df, "updated_at", "timestamp_ntz")
    )
    return df.withColumns(out).drop("merchant", "category", "updated_at")


def find_transactions(
    ledger: DataFrame,
    user_id: str | None = None,
    date_from=None,
    date_to=None,
    amount_min: float | None = None,
    amount_max: float | None = None,
    predicted_category: str | None = None,
    search: str | None = None,
    order_by: str = "date",
    desc: bool = True,
    limit: int | None = 100,
) -> DataFrame:
    """Ledger query with optional filters. Ordered with the id as tie-break; with a limit Spark keeps only
    the top rows per task."""
    if user_id is not None:
        ledger = ledger.filter(F.col("user_id") == user_id)
    if date_from is not None:
        ledger = ledger.filter(F.col("date") >= dates.as_clock(date_from))
    if date_to is not None:
        ledger = ledger.filter(F.col("date") <= dates.as_clock(date_to))
    if amount_min is not None:
        ledger = ledger.filter(F.col("amount") >= float(amount_min))
    if amount_max is not None:
        ledger = ledger.filter(F.col("amount") <= float(amount_max))
    if predicted_category is not None:
        ledger = ledger.filter(F.col("predicted_category") == predicted_category)
    if search is not None:
        term = search.lower()
        hits = [F.lower(F.coalesce(_col(ledger, c), F.lit(""))).contains(term) for c in ("description", "vendor")]
        ledger = ledger.filter(hits[0] | hits[1])
    key = F.col(order_by).desc() if desc else F.col(order_by).asc()
    ledger = ledger.orderBy(key, F.col("transaction_id"))
    return ledger.limit(limit) if limit else ledger


def categorized(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with a real category between two days, both included.

    The day range is written on the timestamp itself, so that it reaches the Parquet scan."""
    begin = F.lit(start).cast("date").cast("timestamp_ntz")
    stop = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return df.filter((F.col("date") >= begin) & (F.col("date") < stop) & (F.col("category") != UNCATEGORIZED))
