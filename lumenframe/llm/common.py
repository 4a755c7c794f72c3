"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}
_SCOPES = threading.local()
BATCH_BYTES = "2m"
#: A side whose bytes, counted beforehand, are at most this is broadcast; beyond it, joins are shuffled.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a local master
    gets a temporary folder and any other master a folder in the warehouse.
    """
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir"):
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if spark.sparkContext.master.split("[")[0] == "local":  # not local-cluster, whose executors are processes of their own
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        else:
            _LOCAL[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, below one folder for each application."""
    path = f"{shared_dir(spark)}/lumenframe/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    for held in getattr(_SCOPES, "open", []):
        held.add(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[set[str]]:
    """What is written within is deleted at the end, but for paths that are taken out of the set."""
    _SCOPES.open = [*getattr(_SCOPES, "open", []), held := set()]
    try:
        yield held
    finally:
        _SCOPES.open = _SCOPES.open[:-1]
        for path in held:
            remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written between steps.

    Results that haven't been written elsewhere can't be read any more then, so
    a long-lived session calls this between jobs.
    """
    remove(spark, f"{shared_dir(spark)}/lumenframe/{spark.sparkContext.applicationId}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that ``scratch`` gave, through the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def _bytes_of(c: Column, kind: T.DataType) -> Column | None:
    """Bytes that a value of variable length takes; none for others."""
    if kind.typeName() in ("string", "binary"):
        return F.octet_length(c)
    if isinstance(kind, T.ArrayType):
        return 24 * F.size(c)
    if isinstance(kind, T.StructType):
        inner = [x for f in kind if (x := _bytes_of(c[f.name], f.dataType)) is not None]
        return sum((F.coalesce(x, F.lit(0)) for x in inner), F.lit(0)) if inner else None
    return None


def small(df: DataFrame, row_bytes: int = 72) -> DataFrame:
    """``df`` marked for broadcast if its rows and the bytes of its text and lists, counted now, are few."""
    wide = [x for f in df.schema if (x := _bytes_of(F.col(f"`{f.name}`"), f.dataType)) is not None]
    n, text = df.agg(F.count("*"), sum((F.coalesce(F.sum(w), F.lit(0)) for w in wide), F.lit(0))).first()
    return F.broadcast(df) if n * row_bytes + text <= BROADCAST_BYTES else df


def trim() -> None:
    """Gives what a task has freed back to the system, as worker processes outlive tasks."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def tidy(run: Callable) -> Callable:
    """A task function over batches that trims its process at the end."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def by_list(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Applies ``run`` (table, bounds of its lists) to whole lists; ``rows``: g and others, with each g in one partition and sorted."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def of(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            g = t.column("g").to_numpy()
            return run(t, np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]]).tolist())

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            g = held.column("g").to_numpy()
            cut = int(np.searchsorted(g == g[-1], True)) if g[0] != g[-1] else 0  # the last list may go on
            if cut:
                yield of(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield of(held)

    return rows.mapInArrow(tidy(lists), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.

    Python workers are told where the driver has found this library, and get
    batches of bounded bytes, as texts may be very long.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, n: int, held: int) -> Column:
    """True for the held-out fold; a null id belongs to the training fold."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % n == held, F.lit(False))


def sampled_labels(labels: DataFrame, id_col: str, label: str, bound: int, n: int = 4, held: int = 2) -> DataFrame:
    """At most ``bound`` labelled ids of each class outside the held-out fold.

    The choice follows a hash of the id, so it neither depends on partitions
    nor on order.  Repeated ids count once (smallest label); nulls are left out.
    """
    rows = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~fold("id", n, held))
        .groupBy("id").agg(F.min("label").alias("label"))
    )
    half = [rows.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(bound) for v in (0, 1)]
    return half[0].unionAll(half[1])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60, balanced: bool = True, share: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Newton steps; ``share``: what each row counts."""
    n, d = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(d + 1)
    if n == 0 or y.min() == y.max():
        w[-1] = 0.0 if n == 0 else (4.0 if y.max() else -4.0)
        return w[:-1], float(w[-1])
    share = np.ones(n) if share is None else share / share.mean()
    positive = (share * y).mean()
    weight = share * np.where(y == 1, 0.5 / max(positive, 1e-9), 0.5 / max(1 - positive, 1e-9)) if balanced else share
    reg = np.full(d + 1, l2 * n)
    reg[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + reg * w
        h = (a.T * (weight * p * (1 - p))) @ a + np.diag(reg + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
