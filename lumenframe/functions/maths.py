"""Division and logarithms that give a value or a null, and never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Whole quotient, cut towards zero; null if the divisor is 0."""
    return F.when(b != 0, F.call_function("div", a, b))


def null_safe_div(a: Column, b: Column) -> Column:
    """Quotient as a double; null if the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; null if the divisor is 0."""
    return F.try_mod(a, b)


def floor_double(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil_double(x: Column) -> Column:
    return F.ceil(x).cast("double")


def _ieee(log: Column, x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(log)


def ln_ieee(x: Column) -> Column:
    """Natural logarithm; minus infinity for 0 and NaN below, where Spark gives null."""
    return _ieee(F.ln(x.cast("double")), x)


def log10_ieee(x: Column) -> Column:
    return _ieee(F.log10(x.cast("double")), x)
