"""Tables of a Hive metastore that the Spark session is connected to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.sources import SourceError


def read_catalog(spark: SparkSession, table: str, database: str = "default") -> DataFrame:
    """The table with its location, format, schema and partitions as the metastore holds them."""
    name = f"`{database}`.`{table}`"
    if not spark.catalog.tableExists(f"{database}.{table}"):
        raise SourceError(f"the catalog has no table {name}")
    return spark.table(name)
