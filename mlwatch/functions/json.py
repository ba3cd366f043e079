"""Reading single values out of JSON text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metric(json: Column, key: str) -> Column:
    """One numeric metric by name; null when it is absent or not a number. Metrics may also hold lists."""
    return F.get_json_object(json, f"$.{key}").try_cast("double")


def text_field(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")
