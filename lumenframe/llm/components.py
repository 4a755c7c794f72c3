"""Connected components by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import materialize, remove


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (a, b).

    Each round every node hands its neighbours to the smallest one it knows.
    The minimum of a node's neighbours is pre-aggregated and joined back, so a
    node with very many neighbours is never gathered in one place; such a join
    can be split by the adaptive planner.  Each round is written to the shared
    folder, which cuts the lineage and outlives a lost executor; what the round
    before has written is deleted then.
    """
    e, held = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        # large star: of both directions, the larger neighbours go to the smallest node around
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("m", "a").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, between = materialize(large, "large-star")
        # small star: the smaller neighbours and the node itself go to the smallest neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        own = large.join(low, F.col("a") == F.col("k"))
        small = own.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).unionAll(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
        small, path = materialize(small, "small-star")
        now = small.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        for old in (held, between):
            remove(edges.sparkSession, old)
        e, held = small, path
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components haven't converged in {most_rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def few_components(edges: DataFrame) -> DataFrame:
    """As ``components``, in the driver: for edges counted to be few.

    The result is an Arrow table, as rows of Python objects would be read by Python workers of another kind,
    which stay on every executor beside those at hand.
    """
    root: dict = {}

    def of(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    pairs = edges.select("a", "b").toArrow()
    for a, b in zip(*(c.to_pylist() for c in pairs.columns), strict=True):
        a, b = of(a), of(b)
        root[max(a, b)] = min(a, b)
    kind, of_kind = edges.schema["a"].dataType.simpleString(), pairs.schema.field("a").type
    found = pa.table({"node": pa.array(list(root), of_kind), "root": pa.array([of(x) for x in root], of_kind)})
    return edges.sparkSession.createDataFrame(found, f"node {kind}, root {kind}")
