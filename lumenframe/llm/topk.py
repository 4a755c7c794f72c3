"""Exact top-k search by inner product, by a three-phase uniform threshold.

A score is the sum of LISTS local scores, one for each slice of the components.
Rows are dealt into blocks by a hash, and each block is cut into its slices, so
the lists of a row stand apart and none sees a whole score.  Queries are cut the
same way and taken a block at a time: its slices are broadcast to the row
slices, so rows never move for them, and what a round writes goes before the next.

1.  Gather: every task reports the k best rows of its part of a list for each
    query.  The scores of the DEEP * k best of a list are resolved exactly; the k-th best
    of them is a safe cutoff, as at least k rows reach it.
2.  Collect: a row that reaches the cutoff falls short of the sum of the lists'
    best by at most the slack between that sum and the cutoff, so in some list it
    falls short of the best by at most its even share of the slack.  Each list
    reports just the entries within that share, packed by block.
3.  Resolve: the entries go to the slices of the other list, where the missing
    scores are looked up and added; what doesn't reach the cutoff goes.

Of rows with one vector only the 2k of smallest id (k at most with one id) can
be among the results, so further copies are dropped before; neither equal
vectors nor ties gather in one place.  Nothing passes through the driver but
counts and the slices of one block of queries, SLICE_BYTES each at most.

Defined cases: null vectors, vectors with a null or non-finite component and
rows with a null id take no part; vectors of different lengths count as padded
with zeros; an empty vector scores 0; rows with the query's id are its own,
other repeated rows count each; repeated query rows (same id and vector) are
one query; no candidates give no rows; local scores beyond 62 bits are cut off
there; other columns take no part.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import by_list, materialize, remove, temporary, tidy

LISTS, SCALE = 2, 256
#: Rows and queries of a block, about, and bytes of its slice at most.
ROW_BLOCK, QUERY_BLOCK, SLICE_BYTES = 4096, 2048, 4 << 20
#: Tasks of the row slices at most, if they outnumber the cores, and blocks of a task then.
TASKS, TASK_BLOCKS = 256, 8
#: Places in a block are counted below this bit of a number.
PLACE = 20
#: Local best rows that are resolved for the cutoff, as a multiple of k: a closer cutoff leaves fewer entries.
DEEP = 8
#: Local scores are cut off here, so that their sum fits 64 bits.
MOST = (1 << 62) - 1
SCHEMA = "query_id long, rank int, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of float, or else of double): rows that take part."""
    kind = vectors.select(vector_col).schema[0].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "array<float>" else "array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)


def first_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with one vector, those that can be among k results; ranks are cut before the exchange too."""
    h = ["h1", "h2"]
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), F.col("v"))})
    for keys, most in ((["id", *h], k), (h, 2 * k)):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("n") <= most)
    return rows.select("id", "v")


def slices(rows: DataFrame, blocks: int, width: int, names: tuple[str, str, str], parts: int) -> DataFrame:
    """list, and by ``names``: number, ids and values of each block of ``rows`` (id, v), one row for each list."""
    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("g"), "id", "v")
    dealt = dealt.repartition(parts, "g").sortWithinPartitions("g", "id")
    edges = [width * i // LISTS for i in range(LISTS + 1)]

    def run(t: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        ids, g = t.column("id").to_numpy(), t.column("g").to_numpy()
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            x = matrix(t.column("v").slice(a, b - a), width)
            own = [np.ascontiguousarray(x[:, p:q]) for p, q in zip(edges, edges[1:], strict=False)]
            out += [(n, int(g[a]), ids[a:b].tobytes(), pack(s)) for n, s in enumerate(own)]
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["list", *names])

    return by_list(dealt, run, f"list int, {names[0]} long, {names[1]} binary, {names[2]} binary")


def matrix(column, width: int) -> np.ndarray:
    """floor(SCALE * x) of each component, as whole numbers; rows are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(size) and size.min() == width:
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where they fit, else in eight."""
    small = not x.size or np.abs(x).max() < 2**15
    return (b"2" if small else b"8") + x.astype("<i2" if small else "<f8").tobytes()


def unpack(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i2" if data[:1] == b"2" else "<f8", offset=1).reshape(rows, -1).astype(np.float64)


def exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as a type in which sums of products are exact."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return q.astype(kind), x.astype(kind)
    if bound < 2**62:
        return q.astype(np.int64), x.astype(np.int64)
    return tuple(np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape) for a in (q, x))


def whole(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([min(max(int(v), -MOST), MOST) for v in scores], dtype=np.int64)
    return scores.astype(np.int64)


def own_places(qi: np.ndarray, xi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that have a query's own id."""
    order = np.argsort(xi, kind="stable")
    low, high = np.searchsorted(xi[order], qi, "left"), np.searchsorted(xi[order], qi, "right")
    n = high - low
    a = np.repeat(np.arange(len(qi)), n)
    return a, order[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


class Best:
    """The ``k`` best rows of a task for each query of a block, block by block of rows."""

    def __init__(self, queries: int, k: int):
        self.k, self.a = k, np.zeros(0, dtype=np.int64)
        self.r, self.s = self.a, self.a
        self.least = np.full(queries, -np.inf)

    def add(self, rank: np.ndarray, s: np.ndarray, first: int) -> None:
        """Takes the local scores of a block of rows, whose places begin at ``first``; ``rank``: floats, -inf for a query's own rows."""
        if rank.shape[1] > self.k and not len(self.a):
            at = np.argpartition(-rank, self.k - 1, axis=1)[:, : self.k]
            a, c = np.repeat(np.arange(len(rank)), self.k), at.ravel()
            known = rank[a, c] > -np.inf
            a, c = a[known], c[known]
        else:
            a, c = np.nonzero(rank > self.least[:, None].astype(rank.dtype))
        a, r, s = np.concatenate([self.a, a]), np.concatenate([self.r, first + c]), np.concatenate([self.s, whole(s[a, c])])
        order = np.lexsort((r, -s, a))
        a, r, s = a[order], r[order], s[order]
        start = np.searchsorted(a, np.arange(len(rank)))
        kept = np.arange(len(a)) - start[a] < self.k
        self.a, self.r, self.s = a[kept], r[kept], s[kept]
        n = np.bincount(self.a, minlength=len(rank))
        full = np.flatnonzero(n == self.k)
        self.least[full] = self.s[np.cumsum(n)[full] - 1]


def of_row(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query and row values, and the ids of both."""
    qi, xi = (np.frombuffer(row[c], dtype=np.int64) for c in ("qids", "ids"))
    return *exact(unpack(row["qx"], len(qi)), unpack(row["x"], len(xi))), qi, xi


def gathered(pairs: DataFrame, k: int) -> DataFrame:
    """Phase 1: a, r, list, s: the ``k`` best rows of each task and list for each query, without the query's own."""

    def run(batches):
        best: dict[int, Best] = {}
        for b in batches:
            for row in b.to_pylist():
                q, x, qi, xi = of_row(row)
                s = q @ x.T
                rank = s if s.dtype.kind == "f" else s.astype(np.float64)
                rank[own_places(qi, xi)] = -np.inf
                best.setdefault(row["list"], Best(len(qi), k)).add(rank, s, row["rb"] << PLACE)
        for n, top in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(top.a), pa.array(top.r), pa.array(np.full(len(top.a), n, dtype=np.int32)), pa.array(top.s)], ["a", "r", "list", "s"])

    return pairs.select("rb", "list", "qids", "qx", "ids", "x").mapInArrow(tidy(run), "a long, r long, list int, s long")


def bounds_of(marks, queries: int) -> tuple[np.ndarray, np.ndarray]:
    """The least local score that a list reports, and the cutoff, of each query; none where at most k rows are there."""
    share, cutoff = np.full(queries, -np.inf), np.full(queries, -(1 << 63), dtype=np.int64)
    for m in marks or ():
        share[m["a"]], cutoff[m["a"]] = np.floor(m["share"]), m["cutoff"]
    return share, cutoff


def place_type(q: np.ndarray, x: np.ndarray) -> type:
    return np.uint32 if len(q) * len(x) < 2**32 else np.int64


def collected(pairs: DataFrame) -> DataFrame:
    """Phase 2: rb, by, list, places, s: of each block, what list ``by`` reports, packed, for each other list."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                q, x, qi, xi = of_row(row)
                share, _ = bounds_of(row["marks"], len(qi))
                s = q @ x.T
                within = s >= share[:, None].astype(s.dtype if s.dtype.kind == "f" else np.float64)
                within[own_places(qi, xi)] = False
                at = np.flatnonzero(within)
                if len(at):
                    local = whole(s.ravel()[at])
                    small = np.abs(local).max() < 2**31
                    packed = (b"4" if small else b"8") + local.astype("<i4" if small else "<i8").tobytes()
                    others = [n for n in range(LISTS) if n != row["list"]]
                    n = len(others)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["rb"]] * n, pa.int64()), pa.array([row["list"]] * n, pa.int32()), pa.array(others, pa.int32()), pa.array([at.astype(place_type(q, x)).tobytes()] * n, pa.binary()), pa.array([packed] * n, pa.binary())],
                        ["rb", "by", "list", "places", "s"],
                    )

    return pairs.select("rb", "list", "qids", "qx", "marks", "ids", "x").mapInArrow(tidy(run), "rb long, by int, list int, places binary, s binary")


def local_scores(q: np.ndarray, x: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Local scores of places: from all of the block where they are many."""
    return whole((q @ x.T)[a, c] if 64 * len(a) > len(q) * len(x) else (q[a] * x[c]).sum(axis=1))


FOUND = "a long, r long, query_id long, vec_id long, s long"


def found(a: np.ndarray, c: np.ndarray, s: np.ndarray, first: int, qi: np.ndarray, xi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(first + c), pa.array(qi[a]), pa.array(xi[c]), pa.array(s)], ["a", "r", "query_id", "vec_id", "s"])


def completed(pairs: DataFrame) -> DataFrame:
    """Phase 3: the whole scores of what list ``by`` has reported, where they reach the cutoff; ``pairs``: of the other list."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                q, x, qi, xi = of_row(row)
                share, cutoff = bounds_of(row["marks"], len(qi))
                a, c = np.divmod(np.frombuffer(row["places"], dtype=place_type(q, x)).astype(np.int64), len(xi))
                here = local_scores(q, x, a, c)
                s = here + np.frombuffer(row["s"], dtype="<i4" if row["s"][:1] == b"4" else "<i8", offset=1)
                kept = s >= cutoff[a]
                if row["list"] < row["by"]:
                    kept &= here < share[a]  # else this list has reported it too
                if kept.any():
                    yield found(a[kept], c[kept], s[kept], row["rb"] << PLACE, qi, xi)

    return pairs.select("rb", "list", "by", "places", "s", "qids", "qx", "marks", "ids", "x").mapInArrow(tidy(run), FOUND)


def resolved(pairs: DataFrame) -> DataFrame:
    """The whole scores of single ``cells`` (place and score in the other list) of a block."""

    def run(batches):
        for b in batches:
            for i, row in enumerate(b.drop_columns(["cells"]).to_pylist()):
                q, x, qi, xi = of_row(row)
                cells = b.column("cells")[i].values
                a, c, s = (cells.field(n).to_numpy() for n in ("a", "c", "s"))
                yield found(a, c, s + local_scores(q, x, a, c), row["rb"] << PLACE, qi, xi)

    return pairs.select("rb", "list", "cells", "qids", "qx", "ids", "x").mapInArrow(tidy(run), FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).distinct()
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    m, wide = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not m:
        return spark.createDataFrame([], SCHEMA)
    width = max(width, wide, 1)
    fits = max(1, SLICE_BYTES // (8 * -(-width // LISTS)))
    nr, nq = -(-n // min(ROW_BLOCK, fits)), -(-m // min(QUERY_BLOCK, fits))
    parts = min(nr, max(2 * spark.sparkContext.defaultParallelism, min(TASKS, nr // TASK_BLOCKS)))
    held, held_path = materialize(slices(first_copies(rows, k), nr, width, ("rb", "ids", "x"), parts), "row-slices")
    put, put_path = materialize(slices(asked, nq, width, ("qb", "qids", "qx"), min(nq, parts)), "query-slices")
    paths = []
    for qb in range(nq):
        if nq > 1:  # Spark deletes shuffle files when the driver collects its garbage
            gc.collect()
            spark.sparkContext._jvm.System.gc()
        with temporary(spark) as written:
            paths.append(materialize(best_rows(held, put.where(F.col("qb") == qb).drop("qb"), k), "ranked")[1])
            written.discard(paths[-1])
    for path in (held_path, put_path):
        remove(spark, path)
    return spark.read.schema(SCHEMA).parquet(*paths)


def best_rows(held: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """The results of one block of queries (list, qids, qx)."""
    low = (1 << PLACE) - 1
    ahead = lambda of, by: Window.partitionBy(*of).orderBy(*by)
    # 1: the best of each list, and the cutoff that their scores give
    best = gathered(held.join(F.broadcast(block), "list"), k).withColumn("n", F.row_number().over(ahead(["a", "list"], [F.desc("s"), "r"]))).where(F.col("n") <= DEEP * k)
    best, _ = materialize(best.drop("n"), "best")
    cell = F.struct("a", F.col("r").bitwiseAND(low).alias("c"), "s")
    cells = best.groupBy(F.shiftright("r", PLACE).alias("rb"), (LISTS - 1 - F.col("list")).alias("list")).agg(F.collect_list(cell).alias("cells"))
    scored = resolved(held.join(cells, ["rb", "list"]).join(F.broadcast(block), "list")).dropDuplicates(["a", "r"])
    cuts = scored.withColumn("n", F.row_number().over(ahead(["a"], [F.desc("s")]))).where(F.col("n") == k).select("a", F.col("s").alias("cutoff"))
    tops = best.groupBy("a").agg(*[F.max(F.when(F.col("list") == n, F.col("s"))).cast("double").alias(f"top{n}") for n in range(LISTS)])
    top = F.array(*[F.col(f"top{n}") for n in range(LISTS)])
    total = sum((F.col(f"top{n}") for n in range(LISTS)), F.lit(0.0))
    # a little below, against rounding
    share = F.element_at(top, F.col("list") + 1) - (total - F.col("cutoff").cast("double")) / LISTS - 1 - (F.aggregate(top, F.lit(0.0), lambda x, y: x + F.abs(y)) + F.abs("cutoff")) * 2.0**-40
    marks = cuts.join(tops, "a").withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(LISTS - 1)))).groupBy("list").agg(F.collect_list(F.struct("a", share.alias("share"), "cutoff")).alias("marks"))
    block, _ = materialize(block.join(marks, "list", "left"), "marked-queries")
    # 2: what is within the even share of the slack in some list; 3: exact scores of what can still be among the k best
    entries = collected(held.join(F.broadcast(block), "list"))
    scored = completed(entries.join(held, ["rb", "list"]).join(F.broadcast(block), "list"))
    ranked = scored.withColumn("rank", F.row_number().over(ahead(["a"], [F.desc("s"), "vec_id"]))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("s").alias("score"))
