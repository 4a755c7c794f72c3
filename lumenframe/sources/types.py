"""Names of column types as users write them, and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Type names of columnar files and frames, and the SQL type each is read as.
NAMES = {
    "bool": "boolean", "boolean": "boolean",
    "int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int",
    "int32": "int", "int": "int", "uint32": "bigint", "int64": "bigint", "long": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float": "float", "float64": "double", "double": "double",
    "str": "string", "string": "string", "object": "string", "category": "string",
    "date": "date", "date32": "date", "datetime64[d]": "date",
    "date64": "timestamp_ntz", "timestamp": "timestamp_ntz",
    "datetime64[s]": "timestamp_ntz", "datetime64[ms]": "timestamp_ntz", "datetime64[us]": "timestamp_ntz", "datetime64[ns]": "timestamp_ntz",
    "timestamp[s]": "timestamp_ntz", "timestamp[ms]": "timestamp_ntz", "timestamp[us]": "timestamp_ntz", "timestamp[ns]": "timestamp_ntz",
}


def sql_type(name: object) -> str:
    """The Spark SQL type for a type name; Spark's own names pass through."""
    text = name.simpleString() if isinstance(name, T.DataType) else str(name).strip().lower()
    return NAMES.get(text, text)


def struct_of(names: list[str], dtypes: list | dict | None) -> T.StructType | None:
    """A read schema from column names and types; None where types are left to inference."""
    if dtypes is None:
        return None
    kinds = [dtypes[n] for n in names] if isinstance(dtypes, dict) else list(dtypes)
    if len(kinds) != len(names):
        raise ValueError(f"{len(names)} names but {len(kinds)} types")
    return T.StructType([T.StructField(n, T.DataType.fromDDL(sql_type(k)), True) for n, k in zip(names, kinds, strict=True)])
