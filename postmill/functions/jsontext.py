"""Tolerant JSON text readers: anything unusable is empty, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_reasons(c: Column) -> Column:
    """JSON array text -> its non-blank strings; other text gives an empty array."""
    items = F.from_json(F.when(F.trim(c).startswith("["), c), "array<string>")
    return F.coalesce(
        F.filter(items, lambda t: t.isNotNull() & (F.trim(t) != "")),
        F.array().cast("array<string>"),
    )


def parse_object(c: Column) -> Column:
    """JSON object text as variant; null for arrays, scalars and broken text."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
