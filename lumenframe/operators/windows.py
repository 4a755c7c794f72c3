"""Windows over a whole table, without gathering it in one partition.

A window without PARTITION BY puts all rows into a single task.  Here the rows
are cut into ranges of the order, each range works alone, and what crosses a
border is passed on by small tables: a row or a few for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.sorting import sort_key


#: Sampled rows for each range, from which the cuts between ranges are taken.
SAMPLE_PER_RANGE = 60


def _orders(items: list) -> list[tuple[str, bool, bool]]:
    """name, descending, nulls first - of each item of an order (see ``sort_key``)."""
    out = []
    for item in items:
        name, way, nulls = (item, "asc", "") if isinstance(item, str) else (*item, "") if len(item) == 2 else item
        down = way.lower() == "desc"
        out.append((name, down, nulls.lower() == "first" if nulls else down))
    return out


def _tied(df: DataFrame, items: list) -> tuple[DataFrame, list]:
    """Adds a hash of the row to the order, so that one key of very many rows is spread over ranges too."""
    named = {f.name: f.dataType for f in df.schema}
    hashable = [n for n, t in named.items() if "map<" not in t.simpleString() and t.typeName() not in ("variant", "void")]
    return df.withColumn("__tie", F.xxhash64(*[F.col(f"`{n}`") for n in hashable]) if hashable else F.lit(0).cast("long")), [*items, "__tie"]


def cut_points(df: DataFrame, items: list, parts: int) -> list:
    """At most ``parts - 1`` rows of key values in the order, taken from a sample; they come to the driver once."""
    names = [n for n, _, _ in _orders(items)]
    keys, wanted = df.select(*names), parts * SAMPLE_PER_RANGE
    total = keys.count()
    sample = keys if total <= wanted else keys.sample(wanted / total, seed=17)
    found = sample.orderBy(*map(sort_key, items)).collect()
    spots = sorted({len(found) * i // parts for i in range(1, parts)} - {0}) if found else []
    return list(dict.fromkeys(found[i] for i in spots))


def range_number(items: list, cuts: list, schema) -> Column:
    """How many cuts stand before the row, or are equal to it: a function of the row's keys alone, found by halving."""
    orders = _orders(items)
    if not cuts:
        return F.lit(0)
    lists = [F.array(*[F.lit(c[n]).cast(schema[n].dataType) for c in cuts]) for n, _, _ in orders]

    def reached(at: Column) -> Column:  # the cut at this place isn't after the row
        out = F.lit(True)
        for (name, down, first), values in reversed(list(zip(orders, lists, strict=True))):
            c, k = F.get(values, at), F.col(name)
            less = F.when(c.isNull(), F.lit(first)).when(k.isNull(), F.lit(not first)).otherwise(c > k if down else c < k)
            out = F.when(c.eqNullSafe(k), out).otherwise(less)
        return out

    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    number = F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), number, lambda at, s: F.when((at + s <= len(cuts)) & reached(at + s - 1), at + s).otherwise(at))


def ranges(df: DataFrame, items: list, parts: int | None = None) -> tuple[DataFrame, list[Column], int]:
    """Rows with __part, which follows the order, the keys of the order within a part, and how many parts there are.

    Cut points are chosen once and stand in the plan, so a row has the same
    part wherever and however often the plan is evaluated; nothing depends on
    how partitions are dealt out or put together.  The input itself must be the
    same each time: one with rand() is refused.
    """
    if not df._jdf.queryExecution().analyzed().deterministic():
        raise ValueError("rows that differ between evaluations can't be numbered; write them first")
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied, items = _tied(df, items)
    cuts = cut_points(tied, items, parts)
    return tied.withColumn("__part", range_number(items, cuts, tied.schema)), list(map(sort_key, items)), len(cuts) + 1


def numbered(df: DataFrame, items: list, name: str = "row_number", parts: int | None = None) -> DataFrame:
    """ROW_NUMBER() OVER (ORDER BY ...): the place in a range plus the rows of the ranges before it.

    One exchange of the rows, a range to each partition; the rows of each range
    are counted by an aggregation of the keys.
    """
    rows, keys, n = ranges(df, items, parts)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__part"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = rows.repartitionById(n, "__part").withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
    return placed.join(F.broadcast(before), "__part").withColumn(name, (F.col("__at") + F.col("__before")).cast("long")).drop("__part", "__at", "__before", "__tie")


def running(df: DataFrame, items: list, value: str, name: str, parts: int | None = None) -> DataFrame:
    """SUM(value) OVER (ORDER BY ... ROWS UNBOUNDED PRECEDING)."""
    rows, keys, n = ranges(df, items, parts)
    sums = rows.groupBy("__part").agg(F.sum(value).alias("__s"))
    before = sums.select("__part", F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.repartitionById(n, "__part").withColumn("__own", own).join(F.broadcast(before), "__part")
    total = F.when(F.col("__before").isNull(), F.col("__own")).when(F.col("__own").isNull(), F.col("__before")).otherwise(F.col("__own") + F.col("__before"))
    return out.withColumn(name, total).drop("__part", "__own", "__before", "__tie")


def bounded_rows(df: DataFrame, items: list, aggregates: dict[str, Column], preceding: int, following: int, parts: int | None = None) -> DataFrame:
    """Aggregates OVER (ORDER BY ... ROWS BETWEEN n PRECEDING AND m FOLLOWING) without PARTITION BY.

    Rows are numbered, cut into blocks of consecutive numbers, and the rows
    near a block's border are repeated in the blocks that need them.
    """
    reach = max(preceding, following, 1)
    rows = numbered(df, items, "__no", parts)
    size = max(reach, 10_000)
    no = F.col("__no") - 1
    blocks = F.sequence(F.greatest(F.floor((no - following) / size), F.lit(0).cast("long")), F.floor((no + preceding) / size))
    spread = rows.withColumn("__block", F.explode(blocks))
    w = Window.partitionBy("__block").orderBy("__no").rowsBetween(-preceding, following)
    out = spread.withColumns({k: v.over(w) for k, v in aggregates.items()})
    return out.where(F.col("__block") == F.floor(no / size)).drop("__block", "__no")
