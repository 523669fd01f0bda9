"""Column functions that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repair_text(c: Column) -> Column:
    """Undo UTF-8 that was read as Latin-1; text that is not that stays as it is."""
    narrow = ~F.regexp_like(c, F.lit("[^\\x00-\\xFF]"))
    raw = F.when(narrow, F.encode(F.when(narrow, c), "ISO-8859-1"))
    valid = F.is_valid_utf8(raw.cast("string"))
    return F.when(narrow & valid, F.when(narrow & valid, raw).cast("string")).otherwise(c)


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y, 0 where that has no value."""
    return F.coalesce(F.try_divide(x, y), F.lit(0.0))


def codes(c: Column, mapping: dict) -> Column:
    """The mapping's value, null for what it lacks."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)
