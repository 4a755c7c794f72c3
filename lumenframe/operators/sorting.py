"""Sort order with nulls stated, and the best rows of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_key(item: str | tuple[str, str] | tuple[str, str, str]) -> Column:
    """``"a"``, ``("a", "desc")`` or ``("a", "desc", "first")``.

    Unless stated, nulls come last in ascending and first in descending order.
    """
    name, way, nulls = ((item, "asc", "") if isinstance(item, str) else (*item, "") if len(item) == 2 else item)
    c, way, nulls = F.col(name), way.lower(), nulls.lower() or ("last" if way.lower() == "asc" else "first")
    return getattr(c, f"{way}_nulls_{nulls}")()


def order_by(df: DataFrame, *items, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sorted rows; with a limit the planner keeps only the best rows of each partition."""
    out = df.orderBy(*map(sort_key, items))
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def top_k_per_group(df: DataFrame, group: list[str], items: list, k: int) -> DataFrame:
    """The first k rows of every group; ranks are cut before the exchange too, so a large group isn't gathered."""
    w = Window.partitionBy(*group).orderBy(*map(sort_key, items))
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")
