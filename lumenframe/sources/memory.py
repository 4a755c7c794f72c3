"""Frames in the driver's memory, and frames that are distributed already."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def is_memory(value: Any) -> bool:
    return isinstance(value, DataFrame) or type(value).__module__.split(".")[0] in ("pandas", "pyarrow")


def from_memory(spark: SparkSession, value: Any) -> tuple[DataFrame, str]:
    """A DataFrame for a pandas or Arrow table, or the DataFrame itself, and its kind.

    pandas data goes through Arrow, so a missing value is a null and not a NaN;
    timestamps carry no time zone.
    """
    if isinstance(value, DataFrame):
        return value, "frame"
    import pyarrow as pa

    kind = "arrow"
    if type(value).__module__.startswith("pandas"):
        value, kind = pa.Table.from_pandas(value, preserve_index=False), "pandas"
    if isinstance(value, pa.RecordBatch):
        value = pa.Table.from_batches([value])
    fields = []
    for f in value.schema:
        t = f.type
        if pa.types.is_timestamp(t) and (t.unit != "us" or t.tz is not None):
            t = pa.timestamp("us")  # below a microsecond is cut off
        elif pa.types.is_date64(t):
            t = pa.date32()
        elif pa.types.is_dictionary(t):
            t = t.value_type
        elif pa.types.is_uint64(t):
            t = pa.decimal128(20, 0)
        elif pa.types.is_unsigned_integer(t):
            t = {8: pa.int16(), 16: pa.int32(), 32: pa.int64()}[t.bit_width]
        elif pa.types.is_float16(t):
            t = pa.float32()
        elif pa.types.is_null(t):
            t = pa.bool_()
        fields.append(pa.field(f.name, t))
    return spark.createDataFrame(value.cast(pa.schema(fields), safe=False)), kind
