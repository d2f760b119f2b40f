"""Column helpers for text semantics that differ between Python and SQL engines."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"  # ISO-like text form of timestamps (UTC)


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII white space (SQL ``trim`` only strips spaces), without a regex."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def falsy(c: Column) -> Column:
    """Python truthiness of an optional string: NULL or ''."""
    return c.isNull() | (c == F.lit(""))


def truthy(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


def nullif_empty(c: Column) -> Column:
    return F.when(c != F.lit(""), c)


def ts_text(c: Column) -> Column:
    """Timestamps leave the engine as ISO text, the reference's storage form."""
    return F.date_format(c, TS_FORMAT)


def str_bool(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))
