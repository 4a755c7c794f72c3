"""Tables in folders named ``column=value``, found or given by the user."""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources import SourceError
from lumenframe.sources.files import read_files
from lumenframe.sources.types import sql_type


def partition_folders(base: str, partitions: dict[str, list]) -> list[str]:
    """One folder for each combination of the listed values."""
    base = base.rstrip("/*").rstrip("/")
    names = list(partitions)
    return [base + "".join(f"/{n}={v}" for n, v in zip(names, values, strict=True)) for values in itertools.product(*partitions.values())]


def read_partitioned(spark: SparkSession, base: str, partitions: Any, schema: Any = None, hint: str | None = None, **args: Any) -> tuple[DataFrame, str]:
    """Only the listed folders are read; those that don't exist are left out."""
    if not isinstance(partitions, dict) or not partitions:
        raise SourceError("partitions must be a dictionary of the form {'column': [value, ...]}")
    if schema is not None and not (isinstance(schema, list) and all(len(x) == 2 for x in schema) and len(schema) == len(partitions)):
        raise SourceError("partitions_schema must be a list of (column, type) pairs, one for each partition column")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = base.rstrip("/*").rstrip("/")
    there = []
    for folder in partition_folders(root, partitions):
        at = jvm.org.apache.hadoop.fs.Path(folder)
        if at.getFileSystem(conf).exists(at):
            there.append(folder)
    if not there:
        raise SourceError(f"none of the listed partitions exists below {root}")
    df, kind = read_files(spark, there, hint, base=root, **args)
    for name, dtype in schema or ():
        df = df.withColumn(name, F.col(name).cast(sql_type(dtype)))
    return df, kind
