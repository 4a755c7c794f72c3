"""Named queries, one for each operator, with the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.queries import aggregates, conditions, joins, scalars, sorting, sources, subqueries, tpch, windows
from lumenframe.queries.registry import Registry

_ALL: list[Registry] = [m.R for m in (conditions, subqueries, joins, aggregates, windows, sorting, scalars, sources, tpch)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for r in _ALL for k, v in r.queries.items()}
ORACLES: dict[str, str] = {k: v for r in _ALL for k, v in r.oracles.items()}
