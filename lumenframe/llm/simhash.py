"""Near-duplicates by SimHash, with pivot distance tables.

Every document gets a 64-bit fingerprint: each bit is the majority over the
hashes of its word shingles.  Equal fingerprints are pre-aggregated.  Two
distinct fingerprints link if they differ in at most ``max_bits`` bits.

The distances of every distinct fingerprint to PIVOTS reference fingerprints
are computed once.  By the triangle inequality two fingerprints within
``max_bits`` differ by no more than that in any of them, so a pair is discarded
at its largest coordinate difference and only survivors are verified bit by
bit.  Pairs are looked for within lists: of ``max_bits + 2`` equal bands of
bits, any linked pair agrees in two at least, so a list holds the fingerprints
that agree in two given bands.  A list longer than LIST is divided the same way
by the bits that are left, and so on; once few enough bits are left, a list
can't be longer, as its fingerprints are distinct.  So no task holds an
unbounded list, nothing is capped and no group is dealt out in all pairs.  A task
reports only the links that join what it hasn't joined yet.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; repeated rows share a fingerprint; rows with one id and different
texts are documents of their own; a group whose ids are all null has no
component id; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import nearcopies
from lumenframe.llm.common import by_list, materialize, small, tidy
from lumenframe.llm.components import components, few_components

WORDS, MAX_BITS, LIST = 3, 2, 256
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 42) for i in range(16)], dtype=np.uint64)
#: Edges that are joined in the driver once counted; beyond it, by stars.
FEW_EDGES = 20_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits over the XXH64 hashes (seed 42) of the shingles, as a signed 64-bit integer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    data, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        hashes = [h(data, 42)]
    else:
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        end = np.cumsum(size + 1) - 1
        hashes = [h(data[a:b], 42) for a, b in zip((end - size)[: len(found) - words + 1].tolist(), end[words - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, h (hash of the text), fp for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["id", "h", "fp"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, h long, fp long")


def with_pivots(reps: DataFrame) -> DataFrame:
    """fp and the table of its distances to the pivots, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in table], pa.binary())], ["fp", "dist"])

    return reps.select("fp").mapInArrow(tidy(run), "fp long, dist binary")


def agreeing(mask: int, max_bits: int) -> list[int]:
    """Bits that any linked pair which agrees in ``mask`` agrees in as well, in one of the ways: two bands more of the bits left."""
    left = [i for i in range(64) if not mask >> i & 1]
    n = max_bits + 2
    cuts = [len(left) * i // n for i in range(n + 1)]
    bands = [sum(1 << i for i in left[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [mask | bands[i] | bands[j] for i, j in combinations(range(n), 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def joined_pairs(group: np.ndarray, fp: np.ndarray, dist: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Linked pairs of rows with equal ``group`` (sorted), without those already joined through others."""
    d = dist.astype(np.int16)
    found = []
    n = len(group)
    alive = np.arange(n)
    for off in range(1, n):
        alive = alive[alive + off < n]
        alive = alive[group[alive] == group[alive + off]]
        if not len(alive):
            break
        near = alive[np.abs(d[alive] - d[alive + off]).max(axis=1) <= max_bits]  # largest coordinate difference
        near = near[np.bitwise_count(fp[near] ^ fp[near + off]) <= max_bits]
        found += zip(near.tolist(), (near + off).tolist(), strict=True)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in found:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def links(reps: DataFrame, max_bits: int = MAX_BITS, most: int = LIST) -> DataFrame:
    """a, b: distinct fingerprints that link, enough to connect all that are linked; ``reps``: fp, distinct."""
    table, _ = materialize(with_pivots(reps), "pivot-table")
    masks, short = agreeing(0, max_bits), []
    wide = table.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    while True:
        keys = wide.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        lists = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        rows, _ = materialize(keys.join(lists, "key"), "fingerprint-lists")
        short.append(rows.where(F.col("n") <= most).select("key", "fp"))
        long = rows.where(F.col("n") > most)
        within = {m: [x for x in agreeing(m, max_bits) if x != m] for m in masks}
        if long.isEmpty() or not any(within.values()):
            short.append(long.select("key", "fp"))
            break
        further = F.create_map(*[x for m, then in within.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(t)) for t in then or [m]]))])
        wide = long.select("fp", F.explode(F.element_at(further, F.col("mask"))).alias("mask")).distinct()
        masks = sorted({x for then in within.values() for x in then})
    lists = reduce(DataFrame.unionAll, short).join(table, "fp").select("key", "fp", "dist").repartition("key").sortWithinPartitions("key", "fp")

    def run(t: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        g, fp = (t.column(c).to_numpy() for c in ("g", "fp"))
        dist = np.frombuffer(b"".join(t.column("dist").to_pylist()), dtype=np.uint8).reshape(-1, len(PIVOTS))
        return nearcopies.pairs_of(t, joined_pairs(g, fp.view(np.uint64), dist, max_bits), "fp")

    found = by_list(lists.select(F.col("key").alias("g"), "fp", "dist"), run, "a long, b long")
    return found.where("a != b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS, most: int = LIST) -> DataFrame:
    """id, fp, component_id (the smallest id reachable) for every row."""
    return _by_fingerprint(docs, id_col, text_col, words, max_bits, most).select("id", "fp", "component_id")


def _by_fingerprint(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int, most: int = LIST) -> DataFrame:
    """id, h, fp, component_id and node (what rows of one component share)."""
    fps, _ = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    reps, _ = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "representatives")
    linked = reps.join(components(links(reps, max_bits, most)), F.col("fp") == F.col("node"))
    low = linked.groupBy("root").agg(F.min("rep").alias("low"))
    linked = linked.select("fp", "root").join(low, "root").select(F.col("fp").alias("node"), "root", "low")
    of_fp, _ = materialize(reps.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("root", "fp").alias("node"), F.coalesce("low", "rep").alias("component_id")), "components")
    return fps.join(of_fp, F.col("fp") == F.col("of")).select("id", "h", "fp", "component_id", "node")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """id, component_id (the smallest id reachable) for every row with an id; pairs at least ``similarity`` alike link.

    Equal word sequences are one document; the others link as ``nearcopies``
    says.  Documents without a word are equal to each other.
    """
    rows = _by_similarity(docs, id_col, text_col, words, similarity)
    low = rows.groupBy("node").agg(F.min("id").alias("component_id"))
    return rows.join(low, "node").select("id", "component_id")


def _by_similarity(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """id, h, node (what rows of one component share), of rows with an id."""
    rows, _ = materialize(nearcopies.sketches(docs, id_col, text_col, words).where("id is not null"), "sketches")
    reps, _ = materialize(rows.groupBy("rep").agg(F.any_value("wide").alias("wide"), F.any_value("keys").alias("keys"), F.min(F.struct("id", "h")).alias("row")), "distinct-texts")
    lists = nearcopies.band_lists(reps)
    pairs, _ = materialize(nearcopies.close_pairs(reps, lists), "close-pairs")
    wanted = pairs.select(F.col("a").alias("w")).unionAll(pairs.select("b")).distinct()
    sets = nearcopies.shingle_sets(wanted, reps, docs, id_col, text_col, words)
    linked, _ = materialize(nearcopies.verified(pairs, sets, similarity), "links")
    roots, _ = materialize(components(linked), "roots")
    more, _ = materialize(nearcopies.further_pairs(reps, lists, roots, sets, similarity), "further-links")
    if n := more.count():
        now = few_components(more) if n <= FEW_EDGES else components(more)
        now, _ = materialize(now.select(F.col("node").alias("was"), F.col("root").alias("now")), "joined-roots")
        roots = (
            roots.join(now, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
            .unionAll(now.join(roots, F.col("was") == F.col("node"), "left_anti"))
        )
    of, _ = materialize(reps.select("rep").join(roots, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("of"), F.coalesce("root", "rep").alias("node")), "components")
    return rows.select("id", "h", "rep").join(of, F.col("rep") == F.col("of")).select("id", "h", "node")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float | None = 0.8, max_bits: int = MAX_BITS) -> DataFrame:
    """Keeps one document of each group, the one with the smallest id; columns stay as they are.

    Groups are those of ``similarity``, or of ``max_bits`` where that is None.
    A document is a row's id and text: of rows with one id, each text stands
    for itself; of equal rows a single one stays; rows without an id stay.
    """
    found = _by_fingerprint(docs, id_col, text_col, words, max_bits).where("id is not null") if similarity is None else _by_similarity(docs, id_col, text_col, words, similarity)
    found, _ = materialize(found.groupBy("node", "id", "h").agg(F.count("*").alias("n")), "groups")
    # written, so that the planner can split the join where one group holds very many rows; groups of one row need none
    first, _ = materialize(found.groupBy("node").agg(F.min(F.struct("id", "h")).alias("first"), F.sum("n").alias("all")).where("all > 1").drop("all"), "groups-first")
    marked = found.join(small(first), "node").withColumn("stays", F.struct("id", "h") == F.col("first"))
    marked, _ = materialize(marked.where("not stays or n > 1").select(F.col("id").alias("__lf_id"), F.col("h").alias("__lf_h"), "stays"), "groups-marked")
    same = (F.col(id_col) == F.col("__lf_id")) & (F.xxhash64(text_col) == F.col("__lf_h"))
    kept = docs.join(small(marked.where("not stays").drop("stays")), same, "left_anti")
    repeated = marked.where("stays").drop("stays")
    if repeated.isEmpty():
        return kept
    repeated = small(repeated)
    return kept.join(repeated, same, "left_anti").unionAll(kept.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))
