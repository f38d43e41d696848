"""Table schemas shared by every job."""

from pyspark.sql import types as T

_LEAF = "mimeType STRING, body STRUCT<data: STRING>"

# A message has recursive parts; Spark types do not recurse. Three levels are typed, and whatever sits
# below the third is kept as JSON text, which the extractor reads to its end.
MESSAGE_DDL = (
    "id STRING, threadId STRING, labelIds ARRAY<STRING>, user_id STRING, "
    "payload STRUCT<mimeType: STRING, headers: ARRAY<STRUCT<name: STRING, value: STRING>>, "
    "body: STRUCT<data: STRING>, "
    "parts: ARRAY<STRUCT<mimeType: STRING, body: STRUCT<data: STRING>, "
    "parts: ARRAY<STRUCT<mimeType: STRING, body: STRUCT<data: STRING>, "
    "parts: ARRAY<STRUCT<mimeType: STRING, body: STRUCT<data: STRING>, parts: STRING>>>>>>>"
)

TRANSACTION_DDL = """
    transaction_id STRING NOT NULL, id_api STRING, user_id STRING NOT NULL, account_id STRING, account STRING,
    template_used STRING, date TIMESTAMP_NTZ, day INT, month INT, year INT, day_name STRING,
    description STRING, vendor STRING, vendor_cleaned STRING, cleaned_metaphone ARRAY<STRING>, user_vendor STRING,
    amount DOUBLE NOT NULL, predicted_category STRING, predicted_subcategory STRING, prediction_confidence DOUBLE,
    model_version STRING, user_category STRING, user_subcategory STRING, user_corrected BOOLEAN,
    feedback_timestamp TIMESTAMP_NTZ, notes STRING, location STRING, tags ARRAY<STRING>, status STRING,
    created_at TIMESTAMP_NTZ, last_modified TIMESTAMP_NTZ
"""

FEEDBACK_DDL = """
    feedback_id STRING NOT NULL, transaction_id STRING NOT NULL, user_id STRING NOT NULL, original_category STRING,
    original_subcategory STRING, user_category STRING NOT NULL, user_subcategory STRING,
    prediction_confidence DOUBLE, model_version STRING, vendor STRING, vendor_cleaned STRING, amount DOUBLE,
    template_used STRING, feedback_timestamp TIMESTAMP_NTZ NOT NULL, transaction_date TIMESTAMP_NTZ
"""

TRAINING_DDL = """
    transaction_id STRING NOT NULL, user_id STRING NOT NULL, vendor STRING, vendor_cleaned STRING,
    cleaned_metaphone ARRAY<STRING>, amount DOUBLE NOT NULL, account STRING, template_used STRING,
    date TIMESTAMP_NTZ NOT NULL, day INT, month INT, year INT, day_name STRING, category STRING, subcategory STRING,
    is_user_corrected BOOLEAN, prediction_confidence DOUBLE, model_version STRING,
    created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ
"""

USER_DDL = """
    user_id STRING NOT NULL, email_sync_enabled BOOLEAN, contactInformation STRUCT<_email: STRING>,
    last_sync TIMESTAMP_NTZ, last_sync_status STRING,
    sync_settings STRUCT<created_at: STRING, updated_at: STRING, created_by: STRING, updated_by: STRING>
"""

REGISTRY_DDL = """
    model_id STRING NOT NULL, version INT, status STRING, traffic_percentage INT, created_at TIMESTAMP_NTZ,
    updated_at TIMESTAMP_NTZ, promoted_at TIMESTAMP_NTZ, path STRING
"""


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
