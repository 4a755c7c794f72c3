"""Plan texts, and facts about physical plans that tests hold on to."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, detail: bool = False) -> str:
    """The optimized logical plan, or the physical plan with the details of each node."""
    execution = df._jdf.queryExecution()
    if not detail:
        return execution.optimizedPlan().toString()
    return execution.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count_nodes(df: DataFrame, pattern: str) -> int:
    """How many physical operators match, such as ``Exchange`` or ``BroadcastHashJoin``."""
    return sum(bool(re.match(rf"[\s:+\-*()\d]*{pattern}", line)) for line in physical(df).splitlines())


def pushed_filters(df: DataFrame) -> list[str]:
    """What each file scan filters by itself."""
    return re.findall(r"PushedFilters: \[(.*?)\]", physical(df))


def read_columns(df: DataFrame) -> list[str]:
    """The columns that each file scan reads."""
    return re.findall(r"ReadSchema: struct<(.*?)>", physical(df))
