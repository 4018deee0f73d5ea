"""Schemas of the ledger tables; one ``StructType`` per table."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
PERCENT = T.DecimalType(6, 2)


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "decimal(12,2)": MONEY,
    "decimal(6,2)": PERCENT,
    "decimal(22,2)": T.DecimalType(22, 2),
    "decimal(28,2)": T.DecimalType(28, 2),
    "array<string>": T.ArrayType(T.StringType()),
    "array<double>": T.ArrayType(T.DoubleType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def table_schema(spec: str) -> T.StructType:
    fields = [field.strip().split(" ") for field in spec.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


WORKSPACES = table_schema("workspace_id string, name string")
SALES = table_schema(
    "workspace_id string, id string, date date, sku string, name string, category string, "
    "quantity int, amount_inr decimal(12,2), margin_pct decimal(6,2), created_at timestamp"
)
PURCHASES = table_schema(
    "workspace_id string, id string, date date, supplier_name string, sku string, "
    "quantity int, amount_inr decimal(12,2), created_at timestamp"
)
PRODUCTS = table_schema(
    "workspace_id string, sku string, name string, category string, "
    "unit_price_inr decimal(12,2), quantity_on_hand int, expires_on date, "
    "created_at timestamp"
)
EXPENSES = table_schema(
    "workspace_id string, id string, occurred_on date, label string, category string, "
    "amount_inr decimal(12,2), created_at timestamp"
)
OBLIGATIONS = table_schema(
    "workspace_id string, id string, label string, category string, "
    "amount_inr decimal(12,2), due_date date, recurrence string, status string, "
    "created_at timestamp"
)
DOCUMENTS = table_schema(
    "workspace_id string, document_id string, title string, kind string, summary string, "
    "uploaded_at date, created_at timestamp"
)
CHUNKS = table_schema(
    "workspace_id string, document_id string, chunk_index int, content string, "
    "embedding array<double>"
)
IMPORT_JOBS = table_schema(
    "workspace_id string, job_id string, import_type string, filename string, "
    "row_count bigint, inferred_mappings map<string,string>, warnings array<string>, "
    "status string, applied_count bigint, affected_collections array<string>, "
    "created_at timestamp, confirmed_at timestamp"
)
IMPORT_ROWS = table_schema(
    "workspace_id string, job_id string, row_index bigint, payload map<string,string>"
)
ACTIONS = table_schema(
    "workspace_id string, id string, title string, detail string, severity string, "
    "action_type string, target_entity string, status string, snoozed_until string, "
    "resolution_note string, created_at timestamp, updated_at timestamp"
)
STATUS_CHANGES = table_schema(
    "workspace_id string, entity_id string, status string, snooze_until string, "
    "resolution_note string, ts timestamp, change_id bigint"
)
PROVIDER_SETTINGS = table_schema(
    "workspace_id string, mode string, providers array<string>, updated_at timestamp"
)
MEMBERS = table_schema("workspace_id string, user_id string, role string, created_at timestamp")
DOCUMENT_FILE = table_schema(
    "id string, title string, kind string, summary string, uploadedAt string"
)

# business date, natural key and display columns of each collection
LEDGERS = {
    "sales": {
        "schema": SALES,
        "date": "date",
        "key": ["workspace_id", "date", "sku", "amount_inr"],
        "columns": ["date", "sku", "name", "category", "quantity", "amount_inr", "margin_pct"],
    },
    "purchases": {
        "schema": PURCHASES,
        "date": "date",
        "key": ["workspace_id", "date", "sku", "amount_inr"],
        "columns": ["date", "supplier_name", "sku", "quantity", "amount_inr"],
    },
    "products": {
        "schema": PRODUCTS,
        "date": "created_at",
        "key": ["workspace_id", "sku"],
        "columns": [
            "sku",
            "name",
            "category",
            "unit_price_inr",
            "quantity_on_hand",
            "expires_on",
        ],
    },
    "expenses": {
        "schema": EXPENSES,
        "date": "occurred_on",
        "key": ["workspace_id", "occurred_on", "label", "amount_inr"],
        "columns": ["occurred_on", "label", "category", "amount_inr"],
    },
    "recurring_obligations": {
        "schema": OBLIGATIONS,
        "date": "due_date",
        "key": ["workspace_id", "label", "due_date"],
        "columns": ["label", "category", "amount_inr", "due_date", "recurrence", "status"],
    },
}
