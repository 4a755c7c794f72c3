"""The session: a catalog of tables over a SparkSession, and SQL on them.

Spark's parser, Catalyst and the adaptive planner do the planning; the session
only registers tables, sets what semantics depend on, and keeps track of
queries that run in the background.
"""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
import warnings
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.plans.dialect import spark_sql
from lumenframe.plans.explain import plan_text
from lumenframe.plans.options import PLANNING, spark_settings
from lumenframe.sources import SourceError, TableSource
from lumenframe.sources.catalogs import read_catalog
from lumenframe.sources.databases import read_database
from lumenframe.sources.files import IGNORED, read_files
from lumenframe.sources.filesystems import FileSystems
from lumenframe.sources.memory import from_memory, is_memory
from lumenframe.sources.partitions import read_partitioned

#: The arguments that create_table takes.
TABLE_ARGUMENTS = frozenset(
    "local_files file_format partitions partitions_schema hive_table_name hive_database_name names dtype delimiter skiprows skipfooter "
    "lineterminator header nrows skip_blank_lines decimal true_values false_values na_values keep_default_na na_filter quotechar quoting "
    "doublequote comment delim_whitespace skipinitialspace use_cols_indexes use_cols_names byte_range_offset byte_range_size compression "
    "lines stripes num_rows use_index max_bytes_chunk_read get_metadata from_sql hostname port username password database table_filter "
    "table_batch_size exact_decimals partition_column lower_bound upper_bound num_partitions".split()
)


@dataclass
class _Query:
    token: int
    text: str
    started: float
    plan: str = ""
    seconds: float | None = None
    rows: int | None = None
    error: str | None = None
    future: Future | None = None


class Session:
    """``create_table``, ``sql`` and what goes with them.

    ``config_options``: engine options (see ``plans.options``) or Spark settings.
    """

    def __init__(self, spark: SparkSession | None = None, config_options: dict[str, Any] | None = None, enable_progress_bar: bool = False):
        if spark is None:
            spark = SparkSession.builder.config("spark.ui.showConsoleProgress", enable_progress_bar).getOrCreate()
        self.spark = spark
        self._settings = PLANNING | {k: v for k, v in spark_settings(config_options).items() if spark.conf.isModifiable(k)}
        self._tables: dict[str, TableSource] = {}
        self._filesystems = FileSystems(spark)
        self._queries: dict[int, _Query] = {}
        self._pool: ThreadPoolExecutor | None = None
        self._lock = threading.RLock()

    @contextlib.contextmanager
    def _planning(self, more: dict[str, str] | None = None) -> Iterator[None]:
        """The session's settings hold within; the caller's SparkSession has its own again afterwards."""
        with self._lock:
            settings = self._settings | (more or {})
            before = {k: self.spark.conf.get(k, None) for k in settings}
            try:
                for k, v in settings.items():
                    self.spark.conf.set(k, v)
                yield
            finally:
                for k, v in before.items():
                    self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    # tables

    def create_table(self, table_name: str, input: Any, **kwargs: Any) -> TableSource:  # noqa: A002
        """Registers a table; one of the same name is replaced.

        ``input``: a path, wildcard or folder or a list of them, a pandas or
        Arrow table, a DataFrame, a database's table name (with ``from_sql``) or
        ``"hive"`` (with ``hive_table_name``).
        """
        for name in kwargs:
            if name not in TABLE_ARGUMENTS:
                raise SourceError(f"create_table has no argument {name!r}; it takes {', '.join(sorted(TABLE_ARGUMENTS))}")
        if kwargs.get("local_files"):
            warnings.warn("local_files has no effect: every executor must reach all files", stacklevel=2)
        if unused := sorted(k for k in IGNORED if kwargs.get(k) is not None):
            warnings.warn(f"no effect, as Spark's readers decide this themselves: {', '.join(unused)}", stacklevel=2)
        if kwargs.get("partitions_schema") is not None and kwargs.get("partitions") is None:
            raise SourceError("partitions_schema needs partitions")
        args = {k: v for k, v in kwargs.items() if k not in IGNORED and k not in ("local_files", "partitions", "partitions_schema", "file_format")}
        with self._planning():
            return self._register(table_name, input, kwargs, args)

    def _register(self, table_name: str, input: Any, kwargs: dict[str, Any], args: dict[str, Any]) -> TableSource:  # noqa: A002
        hint, paths, partitions = kwargs.get("file_format"), [], []
        if kwargs.get("from_sql"):
            frame, kind = read_database(self.spark, kwargs["from_sql"], input, args), kwargs["from_sql"]
        elif kwargs.get("hive_table_name"):
            frame, kind = read_catalog(self.spark, kwargs["hive_table_name"], kwargs.get("hive_database_name", "default")), "hive"
        elif is_memory(input):
            frame, kind = from_memory(self.spark, input)
        elif isinstance(input, list) and input and all(map(is_memory, input)):
            frames = [from_memory(self.spark, x) for x in input]
            frame, kind = frames[0][0], frames[0][1]
            for f, _ in frames[1:]:
                frame = frame.unionByName(f)
        elif isinstance(input, str) or (isinstance(input, list | tuple) and input and all(isinstance(x, str) for x in input)):
            paths = [self._filesystems.resolve(p) for p in ([input] if isinstance(input, str) else input)]
            if kwargs.get("partitions") is not None:
                partitions = list(kwargs["partitions"]) if isinstance(kwargs["partitions"], dict) else []
                frame, kind = read_partitioned(self.spark, paths[0], kwargs["partitions"], kwargs.get("partitions_schema"), hint, **args)
            else:
                frame, kind = read_files(self.spark, paths, hint, **args)
        else:
            raise SourceError(f"can't make a table of {type(input).__name__}")
        source = TableSource(table_name, kind, frame, paths, {k: v for k, v in args.items() if k != "password"}, partitions)
        frame.createOrReplaceTempView(table_name)
        with self._lock:
            self._tables[table_name] = source
        return source

    def drop_table(self, table_name: str) -> None:
        with self._lock:
            self._tables.pop(table_name, None)
        self.spark.catalog.dropTempView(table_name)

    def list_tables(self) -> list[str]:
        return list(self._tables)

    def describe_table(self, table_name: str) -> dict[str, str]:
        """Column names and types; empty where there is no such table."""
        source = self._tables.get(table_name)
        return dict(source.frame.dtypes) if source else {}

    # queries

    def sql(self, query: str, config_options: dict[str, Any] | None = None, return_token: bool = False) -> DataFrame | int:
        """The result as a lazy DataFrame, or a token of a query that runs in the background.

        ``config_options`` hold while this query is planned; settings that are
        read when it runs must be set for the session.
        """
        with self._lock:
            q = _Query(len(self._queries) + 1, query, time.time())
            self._queries[q.token] = q
        settings = spark_settings(config_options)
        try:
            with self._planning(settings):
                frame = self.spark.sql(spark_sql(query))
                if settings or return_token:
                    q.plan = plan_text(frame)
        except Exception as e:
            q.error = str(e).splitlines()[0][:500]
            raise
        finally:
            q.seconds = time.time() - q.started
        if not return_token:
            return frame
        if self._pool is None:
            self._pool = ThreadPoolExecutor(8, thread_name_prefix="query")
        q.future = self._pool.submit(self._run, q, frame)
        return q.token

    def _run(self, q: _Query, frame: DataFrame) -> tuple[str, list[str], Any]:
        """Writes the result to the folder that driver and executors share; the driver holds none of it."""
        began = time.time()
        try:
            self.spark.sparkContext.setJobGroup(f"query-{q.token}", q.text[:200], True)
            base = self.spark.sparkContext.getConf().get("spark.checkpoint.dir") or self.spark.conf.get("spark.sql.warehouse.dir")
            path, names = f"{base.rstrip('/')}/results/{uuid.uuid4().hex}", frame.columns
            plain = frame.toDF(*[f"c{i}" for i in range(len(names))])  # names may repeat
            plain = plain.select(*[F.col(c).cast("string") if t == "void" else F.col(c) for c, t in plain.dtypes])
            plain.write.parquet(path)
            q.rows = self.spark.read.schema(plain.schema).parquet(path).count()
            return path, names, plain.schema
        except Exception as e:
            q.error = str(e).splitlines()[0][:500]
            raise
        finally:
            q.seconds = time.time() - began

    def _known(self, token: int) -> _Query:
        if token not in self._queries or self._queries[token].future is None:
            raise KeyError(f"no background query has the token {token}")
        return self._queries[token]

    def status(self, token: int) -> bool:
        """Whether the background query has ended."""
        return self._known(token).future.done()

    def fetch(self, token: int) -> DataFrame:
        """Waits for the background query; its result as it was written, or its error."""
        path, names, schema = self._known(token).future.result()
        return self.spark.read.schema(schema).parquet(path).toDF(*names)

    def release(self, token: int) -> None:
        """Deletes the result of a background query that has ended; its line in the log stays."""
        q = self._known(token)
        if not q.future.done():
            raise RuntimeError(f"query {token} is running")
        if not q.future.exception():
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(q.future.result()[0])
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        q.future = None

    def explain(self, sql: str, detail: bool = False) -> str:
        with self._planning():
            return plan_text(self.spark.sql(spark_sql(sql)), detail)

    def log(self, query: str, logs_table_name: str = "query_log") -> DataFrame:
        """SQL over the session's own log: token, query, started, seconds, rows, status, error, plan."""
        with self._lock:
            rows = [(q.token, q.text, q.started, q.seconds, q.rows, "failed" if q.error else "done" if q.future is None or q.future.done() else "running", q.error, q.plan) for q in self._queries.values()]
        frame = self.spark.createDataFrame(rows, "token int, query string, started double, seconds double, rows long, status string, error string, plan string")
        frame.withColumn("started", F.timestamp_micros((F.col("started") * 1_000_000).cast("long")).cast("timestamp_ntz")).createOrReplaceTempView(logs_table_name)
        return self.spark.sql(query)

    # storage

    def localfs(self, prefix: str, **kwargs: Any) -> bool:
        return self._filesystems.register("local", prefix, **kwargs)

    def hdfs(self, prefix: str, **kwargs: Any) -> bool:
        return self._filesystems.register("hdfs", prefix, **kwargs)

    def s3(self, prefix: str, **kwargs: Any) -> bool:
        return self._filesystems.register("s3", prefix, **kwargs)

    def gs(self, prefix: str, **kwargs: Any) -> bool:
        return self._filesystems.register("gs", prefix, **kwargs)

    def show_filesystems(self) -> list[tuple[str, str, str]]:
        return self._filesystems.listing()

    # memory of the executors

    def _memory(self) -> dict[str, tuple[int, int]]:
        status = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
        found = self.spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status)
        return {str(k): (int(found[k]._1()), int(found[k]._2())) for k in found}

    def get_free_memory(self) -> dict[int, int]:
        """Free storage memory in bytes by executor number."""
        return {i: free for i, (_, (_, free)) in enumerate(sorted(self._memory().items()))}

    def get_max_memory_used(self) -> dict[int, int]:
        """Storage memory in use since the last reset, at most, as far as it was looked at."""
        now = {i: most - free for i, (_, (most, free)) in enumerate(sorted(self._memory().items()))}
        self._peak = {i: max(n, getattr(self, "_peak", {}).get(i, 0)) for i, n in now.items()}
        return self._peak

    def reset_max_memory_used(self) -> None:
        self._peak = {}

    def partition(self, input: DataFrame, by: list[str] | None = None) -> DataFrame:  # noqa: A002
        """The rows dealt out by columns, so that joins and groups on them need no other exchange."""
        return input.repartition(*by) if by else input
