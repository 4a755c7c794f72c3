"""Columnar and text files through Spark's readers.

Column pruning, predicate pushdown, splitting into chunks and skipping of row
groups by their statistics are the readers' own; this module only chooses the
reader and translates options.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.sources import SourceError
from lumenframe.sources.types import struct_of

#: File extensions and the format and field separator that each stands for.
EXTENSIONS = {"parquet": ("parquet", None), "orc": ("orc", None), "json": ("json", None), "csv": ("csv", ","), "psv": ("csv", "|"), "tbl": ("csv", "|"), "txt": ("csv", "|")}
#: Options that other engines need and Spark's readers decide themselves.
IGNORED = frozenset({"get_metadata", "max_bytes_chunk_read", "use_index", "byte_range_offset", "byte_range_size", "compression", "na_filter", "keep_default_na", "skip_blank_lines"})


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].rstrip("*")
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of data files that a path, folder or wildcard stands for (the first level that has any)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs, todo = at.getFileSystem(conf), [at]
    for _ in range(12):
        found = [s for p in todo for s in (fs.globStatus(p) or ())]
        found = [x for s in found for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
        files = sorted(s.getPath().toString() for s in found if s.isFile() and s.getPath().getName()[0] not in "_.")
        if files:
            return files
        todo = [s.getPath() for s in found if s.isDirectory()]
        if not todo:
            break
    return []


def file_format(spark: SparkSession, paths: list[str], hint: str | None = None) -> tuple[str, str | None]:
    """Format and separator, by the hint or the extension of the first file."""
    for name in [hint] if hint and hint != "undefined" else [extension(p) for p in paths] + [extension(f) for p in paths[:1] for f in listed(spark, p)[:1]]:
        if name and name.lower() in EXTENSIONS:
            return EXTENSIONS[name.lower()]
    raise SourceError(f"can't tell the file format of {paths[:3]}; set file_format")


def _text_options(reader: DataFrameReader, sep: str | None, args: dict[str, Any]) -> DataFrameReader:
    sep = args.get("delimiter") or args.get("sep") or ("\\s+" if args.get("delim_whitespace") else sep or ",")
    if sep == "\\s+":
        sep = " "
    quote = args.get("quotechar") or '"'
    reader = reader.option("sep", sep).option("quote", "\0" if args.get("quoting") == 3 else quote)  # 3: no quotes
    if args.get("doublequote", True):
        reader = reader.option("escape", quote)
    if args.get("lineterminator"):
        reader = reader.option("lineSep", args["lineterminator"])
    if args.get("comment"):
        reader = reader.option("comment", args["comment"])
    if args.get("skipinitialspace") or args.get("delim_whitespace"):
        reader = reader.option("ignoreLeadingWhiteSpace", True)
    nulls = args.get("na_values")
    if nulls is not None:
        reader = reader.option("nullValue", nulls[0] if isinstance(nulls, list | tuple) and nulls else nulls)
    return reader


def _csv(spark: SparkSession, paths: list[str], sep: str | None, args: dict[str, Any], base: str | None) -> DataFrame:
    names, dtypes, header = args.get("names"), args.get("dtype"), args.get("header", "infer")
    if isinstance(dtypes, dict) and not names:
        names = list(dtypes)
    has_header = names is None if header == "infer" else header is not None and header is not False and header != -1
    reader = _text_options(spark.read, sep, args).option("header", has_header)
    if base:
        reader = reader.option("basePath", base)
    schema = struct_of(names, dtypes) if names and dtypes is not None else None
    if schema is not None:
        # true_values and false_values: read as text and looked up afterwards
        lookup = [f.name for f in schema if isinstance(f.dataType, T.BooleanType)] if args.get("true_values") or args.get("false_values") else []
        read = T.StructType([T.StructField(f.name, T.StringType() if f.name in lookup else f.dataType) for f in schema])
        df = reader.schema(read).csv(paths)
        for name in lookup:
            c = F.col(name)
            df = df.withColumn(name, F.when(c.isin(*args.get("true_values", ["true"])), True).when(c.isin(*args.get("false_values", ["false"])), False))
        return df
    # types are inferred from the first file and then hold for all of them; a value that doesn't fit raises
    first = (listed(spark, paths[0]) or paths)[:1]
    inferred = _text_options(spark.read, sep, args).option("header", has_header).option("inferSchema", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").option("preferDate", True).csv(first)
    kinds = [T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType) else f.dataType for f in inferred.schema]
    columns = list(names) if names else inferred.columns
    return reader.option("mode", "FAILFAST").schema(T.StructType([T.StructField(n, k) for n, k in zip(columns, kinds, strict=True)])).csv(paths)


def _json(spark: SparkSession, paths: list[str], args: dict[str, Any], base: str | None) -> DataFrame:
    reader = spark.read.option("multiLine", not args.get("lines", True)).option("prefersDecimal", False)
    if base:
        reader = reader.option("basePath", base)
    dtypes, names = args.get("dtype"), args.get("names")
    if isinstance(dtypes, dict):
        names = names or list(dtypes)
    schema = struct_of(names, dtypes) if names and dtypes is not None and not isinstance(dtypes, bool) else None
    if schema is None:  # the first file's schema holds for all; a value that doesn't fit raises
        reader = reader.option("mode", "FAILFAST")
        first = (listed(spark, paths[0]) or paths)[:1]
        schema = spark.read.option("multiLine", not args.get("lines", True)).json(first).schema
    return reader.schema(schema).json(paths)


def decimals_as_doubles(df: DataFrame) -> DataFrame:
    """Decimal columns as doubles, which is what columnar files' decimals are read as by default."""
    found = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({n: F.col(f"`{n}`").cast("double") for n in found}) if found else df


def read_files(spark: SparkSession, paths: list[str], hint: str | None = None, base: str | None = None, **args: Any) -> tuple[DataFrame, str]:
    """The files as a DataFrame, and their format."""
    kind, sep = file_format(spark, paths, hint)
    if kind == "csv":
        df = _csv(spark, paths, sep, args, base)
    elif kind == "json":
        df = _json(spark, paths, args, base)
    else:
        reader = spark.read.option("basePath", base) if base else spark.read
        df = reader.format(kind).load(paths)
        df = df if args.get("exact_decimals") else decimals_as_doubles(df)
    if args.get("use_cols_names"):
        df = df.select(*args["use_cols_names"])
    elif args.get("use_cols_indexes"):
        df = df.select(*[df.columns[i] for i in args["use_cols_indexes"]])
    if args.get("skiprows"):
        df = df.offset(int(args["skiprows"]))
    rows = args.get("num_rows", args.get("nrows"))
    if rows is not None and rows >= 0:
        df = df.limit(int(rows))
    return df, kind
