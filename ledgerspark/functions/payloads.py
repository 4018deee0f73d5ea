"""Payloads, mappings and lists as JSON text, for exchange with other stores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_MAP = T.MapType(T.StringType(), T.StringType())
TEXT_LIST = T.ArrayType(T.StringType())


def to_json(value: Column) -> Column:
    """JSON object of a map, or JSON array of a list."""
    return F.to_json(value)


def map_from_json(text: Column) -> Column:
    """Map of a JSON object; values as text, fields that are null left out."""
    return F.map_filter(F.from_json(text, TEXT_MAP), lambda _, value: value.isNotNull())


def list_from_json(text: Column) -> Column:
    """List of a JSON array, empty where there is none."""
    return F.coalesce(F.from_json(text, TEXT_LIST), F.array().cast("array<string>"))
