"""Unions by position with types brought together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]


def common_type(a: T.DataType, b: T.DataType) -> str:
    """Numbers and booleans widen, floats win over whole numbers, text wins over all else."""
    x, y = a.simpleString(), b.simpleString()
    if x == y:
        return x
    if x in RANKS and y in RANKS:
        wide = max(x, y, key=RANKS.index)
        return "double" if wide == "float" and {"int", "bigint"} & {x, y} else wide
    if {x, y} == {"date", "timestamp_ntz"}:
        return "timestamp_ntz"
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        return "double" if "float" in (x, y) or "double" in (x, y) else "decimal(38,10)"
    return "string"


def widened_union(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    """Columns by position under the first frame's names; common types for each."""
    if len({len(f.columns) for f in frames}) != 1:
        raise ValueError("the frames must have as many columns each")
    names = frames[0].columns
    kinds = [reduce(lambda a, b: a if a.simpleString() == b.simpleString() else T.DataType.fromDDL(common_type(a, b)), [f.schema[i].dataType for f in frames]) for i in range(len(names))]
    cast = [f.toDF(*names).select(*[F.col(f"`{n}`").cast(k).alias(n) for n, k in zip(names, kinds, strict=True)]) for f in frames]
    out = reduce(DataFrame.unionAll, cast)
    return out.distinct() if distinct else out
