"""Groups without aggregates, and counts over several columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each combination; nulls are equal to each other."""
    return df.dropDuplicates(columns) if columns else df.distinct()


def count_rows_with_all(*columns: str) -> Column:
    """COUNT(a, b, ...): rows where none of the columns is null."""
    return F.count(F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]), 1))
