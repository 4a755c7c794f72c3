"""Tables of relational databases through the JDBC source.

Filters and column pruning reach the database by the source's own pushdown;
``table_filter`` is put into the query that the database runs.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lumenframe.sources import SourceError

#: Engines, their default ports and driver classes.
ENGINES = {
    "mysql": (3306, "com.mysql.cj.jdbc.Driver"),
    "postgresql": (5432, "org.postgresql.Driver"),
    "sqlite": (None, "org.sqlite.JDBC"),
}


def jdbc_options(engine: str, table: str, args: dict[str, Any]) -> dict[str, str]:
    """Options for ``spark.read.format("jdbc")``; raises SourceError where one is missing."""
    if engine not in ENGINES:
        raise SourceError(f"unknown database engine {engine!r}; there are {', '.join(ENGINES)}")
    needed = ("database",) if engine == "sqlite" else ("hostname", "username", "password", "database")
    missing = [k for k in needed if not args.get(k)]
    if missing:
        raise SourceError(f"missing argument for {engine}: {', '.join(missing)}")
    port, driver = ENGINES[engine]
    url = f"jdbc:sqlite:{args['database']}" if engine == "sqlite" else f"jdbc:{engine}://{args['hostname']}:{args.get('port') or port}/{args['database']}"
    where = args.get("table_filter")
    options = {
        "url": url, "driver": driver, "fetchsize": str(args.get("table_batch_size") or 100_000),
        "dbtable": f"(SELECT * FROM {table} WHERE {where}) AS filtered" if where else table,
        "pushDownPredicate": "true", "pushDownAggregate": "true", "pushDownLimit": "true",
    }
    if engine != "sqlite":
        options |= {"user": args["username"], "password": args["password"]}
    # a split column reads ranges of it in parallel
    if args.get("partition_column"):
        options |= {"partitionColumn": args["partition_column"], "lowerBound": str(args["lower_bound"]), "upperBound": str(args["upper_bound"]), "numPartitions": str(args.get("num_partitions", 8))}
    return options


def read_database(spark: SparkSession, engine: str, table: str, args: dict[str, Any]) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(engine, table, args)).load()
