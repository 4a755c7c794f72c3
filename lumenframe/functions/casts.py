"""Casts between numbers, text and times that never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_from_ns(n: Column) -> Column:
    """Timestamp from nanoseconds since 1970; parts below a microsecond are cut off."""
    return F.timestamp_micros(F.floor(n / 1000).cast("long")).cast("timestamp_ntz")


def days_to_date(n: Column) -> Column:
    return F.date_from_unix_date(n.cast("int"))


def to_number(s: Column, kind: str = "bigint") -> Column:
    """Number from text; null where the text isn't one."""
    return s.try_cast(kind)


def to_text(x: Column, kind: str) -> Column:
    """Text of a boolean, number, date or timestamp (to the second)."""
    if kind == "timestamp":
        return F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    if kind == "date":
        return F.date_format(x, "yyyy-MM-dd")
    return x.cast("string")
