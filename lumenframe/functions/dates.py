"""Dates and times without a zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strptime directives and the Java pattern letters for them.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS",
    "j": "DDD", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "z": "xx", "Z": "VV", "%": "%",
}
UNITS = frozenset({"SECOND", "MINUTE", "HOUR", "DAY"})


def java_format(pattern: str) -> str:
    """A strptime pattern as a Java one; runs of letters that aren't directives are quoted."""
    out = []
    for directive, literal, other in re.findall(r"%(.)|((?:[^\W\d_]|[\[\]{}#'])+)|(.)", pattern, re.S):
        if directive and directive not in DIRECTIVES:
            raise ValueError(f"unknown directive %{directive}")
        out.append(DIRECTIVES[directive] if directive else "'" + literal.replace("'", "''") + "'" if literal else other)
    return "".join(out)


def parse_date(s: Column, pattern: str = "%Y-%m-%d") -> Column:
    """Date from text; null where the text doesn't fit."""
    return F.try_to_timestamp(s, F.lit(java_format(pattern))).cast("date")


def parse_timestamp(s: Column, pattern: str = "%Y-%m-%d %H:%M:%S") -> Column:
    """Timestamp without a zone from text; null where the text doesn't fit."""
    return F.try_to_timestamp(s, F.lit(java_format(pattern))).cast("timestamp_ntz")


def day_of_week(x: Column, first: str = "monday") -> Column:
    """1 to 7, from Monday (ISO) or from Sunday."""
    return F.weekday(x) + 1 if first == "monday" else F.dayofweek(x)


def ts_diff(unit: str, start: Column, end: Column) -> Column:
    """Whole units from ``start`` to ``end``, cut towards zero."""
    if unit.upper() not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(sorted(UNITS))}")
    return F.timestamp_diff(unit.upper(), start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))
