"""Near copies at a given shingle similarity, by SimHash fingerprints and pivot tables.

At a similarity of 0.8 two 256-bit fingerprints differ in a sixth of their bits
on average, with no bound, so bits may rank pairs but never discard one.
Pairs are looked for among documents that agree in a band of MinHash values of
their shingles (BANDS bands of ROWS values: all but 1 in 5000 pairs at 0.8 agree
in one).

1.  Within a list of such documents a minimum spanning forest over the Hamming
    distances of the fingerprints names the closest pairs, at most one fewer
    than there are documents.  A list longer than LIST is dealt into blocks,
    each with the list's first document, so nothing is repeated.  Each pair is
    verified by the exact similarity of the shingle sets.
2.  A link can lie between pairs that have failed.  Every list whose documents
    the verified pairs haven't joined is looked at again, in whole: pivot
    tables hold the Hamming distances of its documents' shingle sets, taken as
    bit vectors, to those of up to PIVOTS documents of the list.  By the
    triangle inequality a pair whose largest coordinate difference is above what the
    similarity allows can't be linked, so discarding it loses nothing;
    survivors between parts not yet joined are verified.  Of a list longer than
    LIST, documents outside the largest part meet all others block by block;
    those within it, joined already, don't meet each other.

A document is known by the hash of its word sequence, so repeated ids and
documents without one do no harm here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import by_list, materialize, small, tidy

BANDS, ROWS, LIST, WIDE_BITS, PIVOTS = 16, 4, 512, 256, 16
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = _RNG.integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sequence_hash(found: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(found))


def shingle_set(found: list[bytes], words: int) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles; fewer words are one shingle, none are none."""
    if not found:
        return np.zeros(0, dtype=np.uint64)
    data, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(data, 42)], dtype=np.uint64)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    end = np.cumsum(size + 1) - 1
    n = len(found) - words + 1
    return np.unique(np.fromiter((h(data[a:b], 42) for a, b in zip((end - size)[:n].tolist(), end[words - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """256 majority bits."""
    ones, n = np.zeros(256, dtype=np.int64), len(hashes)
    for at in range(0, n, 1 << 13):
        part = hashes[at : at + (1 << 13), None] * _MIX[None, :]
        part ^= part >> np.uint64(29)
        part *= _MIX[None, ::-1]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 32), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > n).tobytes()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of smallest values."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(low, ((hashes[at : at + (1 << 12), None] ^ _B[None, :]) * _A[None, :]).min(axis=0), out=low)
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, h (hash of the text), rep (hash of the word sequence), wide, keys for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, wide, keys = [], [], []
            for t in b.column(2):
                found = normal_words(t.as_py())
                hashes = shingle_set(found, words)
                rep.append(sequence_hash(found))
                wide.append(wide_fingerprint(hashes))
                keys.append(band_keys(hashes).tolist() if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rep, pa.binary()), pa.array(wide, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "h", "rep", "wide", "keys"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, h long, rep binary, wide binary, keys array<bigint>")


def spanning_forest(wide: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of a minimum spanning forest over Hamming distances up to ``most``; ``wide``: (n, 4) of u64."""
    n = len(wide)
    if n == 2:
        return [(0, 1)] if np.bitwise_count(wide[0] ^ wide[1]).sum() <= most else []
    best = np.full(n, 999, dtype=np.int64)
    source, out = np.zeros(n, dtype=np.int64), []
    left = np.ones(n, dtype=bool)
    at = 0
    for _ in range(n):
        left[at] = False
        d = np.bitwise_count(wide ^ wide[at]).sum(axis=1, dtype=np.int64)
        nearer = left & (d < best)
        best[nearer], source[nearer] = d[nearer], at
        best[at] = 10_000
        at = int(best.argmin())
        if not left[at]:
            break
        if best[at] <= most:
            out.append((int(source[at]), at))
    return out


def band_lists(reps: DataFrame) -> DataFrame:
    """key, rep, n, lead: the documents of each list of two at least, its size and its first document; ``reps``: rep, wide, keys."""
    keys = reps.select("rep", F.explode("keys").alias("key"))
    lists = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lead")).where("n > 1")
    rows, _ = materialize(keys.join(lists, "key"), "band-lists")
    return rows


def pairs_of(t: pa.Table, got: list[tuple[int, int]], of: str = "rep") -> pa.RecordBatch:
    rep = t.column(of)
    return pa.RecordBatch.from_arrays([rep.take(pa.array([p[k] for p in got], pa.int64())).combine_chunks() for k in (0, 1)], ["a", "b"])


def wide_array(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("wide").to_pylist()), dtype=np.uint64).reshape(-1, 4)


def ordered(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def close_pairs(reps: DataFrame, lists: DataFrame, list_size: int = LIST) -> DataFrame:
    """a, b: the closest pairs of documents in each list, or in each block of a long list."""
    blocks, long = F.ceil(F.col("n") / list_size), F.col("n") > list_size
    own = lambda c: F.pmod(F.xxhash64(c), blocks)
    dealt = lists.select("rep", F.when(long, F.xxhash64("key", own("rep"))).otherwise(F.xxhash64("key")).alias("g"))
    leads = lists.where(long & (F.col("rep") == F.col("lead"))).select("key", "rep", own("rep").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j"))
    dealt = dealt.unionAll(leads.where("own != j").select("rep", F.xxhash64("key", "j").alias("g")))
    rows = dealt.join(reps.select("rep", "wide"), "rep").repartition("g").sortWithinPartitions("g", "rep")

    def run(t: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        wide = wide_array(t)
        return pairs_of(t, [(a + x, a + y) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1 for x, y in spanning_forest(wide[a:b], WIDE_BITS)])

    return ordered(by_list(rows.select("g", "rep", "wide"), run, "a binary, b binary"))


def alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(p, q, assume_unique=True))
    return shared >= similarity * (len(p) + len(q) - shared) - 1e-9


def pivot_table(sets: list[np.ndarray], pivots: list[int]) -> np.ndarray:
    """Hamming distances of the sets, as bit vectors, to the sets of the pivots and to the empty one."""
    size = np.array([len(x) for x in sets])
    flat, ends = np.concatenate(sets), np.cumsum(size)
    out = [size]
    for p in pivots:
        own = sets[p]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        shared = np.concatenate([[0], np.cumsum(own[at] == flat)])
        out.append(size + len(own) - 2 * (shared[ends] - shared[ends - size]))
    return np.stack(out, axis=1)


def joining_pairs(wide: np.ndarray, sets: list[np.ndarray], parts: list, similarity: float) -> list[tuple[int, int]]:
    """Pairs at least ``similarity`` alike that join documents of different ``parts``, enough to join all that are so linked.

    The sets are not empty.  Of two sets with n and m members that are alike,
    at most (1 - s) / (1 + s) * (n + m) members are in one only.
    """
    number = {c: k for k, c in enumerate(dict.fromkeys(parts))}
    part = np.array([number[c] for c in parts])
    size, out, most = np.array([len(x) for x in sets]), [], (1 - similarity) / (1 + similarity)
    # one document of each part, then others, stand as pivots; a few documents need none but the empty set
    first = list(dict.fromkeys([*np.unique(part, return_index=True)[1].tolist(), *range(len(sets))])) if len(sets) > 4 else []
    table = pivot_table(sets, first[:PIVOTS])
    for i in range(len(sets) - 1):
        near = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
        if not len(near):
            continue
        near = near[np.abs(table[near] - table[i]).max(axis=1) <= most * (size[near] + size[i]) + 1e-6]  # largest coordinate difference
        d = np.bitwise_count(wide[near] ^ wide[i]).sum(axis=1, dtype=np.int64)
        for j in near[np.argsort(d, kind="stable")].tolist():
            if part[i] != part[j] and alike(sets[i], sets[j], similarity):
                part[part == part[j]] = part[i]
                out.append((i, j))
    return out


def further_pairs(reps: DataFrame, lists: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, list_size: int = LIST) -> DataFrame:
    """a, b: the roots, or documents without one, that further links of the lists join; ``roots``: node, root.

    ``sets``: rep, s of every document that shares a list, as each such has a pair in the forest.
    """
    parts = sets.select("rep").join(roots, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("part"))
    rows = lists.select("key", "rep", "n").join(parts, "rep")
    counts, _ = materialize(rows.groupBy("key", "n", "part").agg(F.count("*").alias("c")), "parts-of-lists")
    apart = counts.groupBy("key", "n").agg(F.max(F.struct("c", "part")).alias("m")).where("m.c < n").select("key", F.col("m.part").alias("main"), F.col("m.c").alias("c"))
    rows = rows.join(apart, "key")
    half = max(1, list_size // 2)
    inner, outer = F.ceil(F.col("c") / half), F.ceil((F.col("n") - F.col("c")) / half)  # blocks of the largest part, and of what is outside of it
    numbers = lambda m: F.sequence(F.lit(0).cast("long"), m - 1)
    inside, mine = F.col("part") == F.col("main"), lambda m: F.pmod(F.xxhash64("rep"), m)
    own = mine(outer)
    tasks = (
        F.when(F.col("n") <= list_size, F.array(F.xxhash64("key")))
        .when(inside, F.transform(numbers(outer), lambda i: F.xxhash64("key", F.lit("across"), i, mine(inner))))
        .otherwise(F.concat(F.transform(numbers(inner), lambda j: F.xxhash64("key", F.lit("across"), own, j)), F.transform(numbers(outer), lambda j: F.xxhash64("key", F.lit("outside"), F.least(own, j), F.greatest(own, j)))))
    )
    rows, _ = materialize(rows.select("rep", "part", F.explode(tasks).alias("g")), "lists-apart")
    held = rows.join(reps.select("rep", "wide"), "rep").join(sets, "rep").repartition("g").sortWithinPartitions("g", "rep")

    def run(t: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        wide, part, s = wide_array(t), t.column("part").to_pylist(), t.column("s").combine_chunks()
        got = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            found = [np.frombuffer(s[i].as_buffer(), dtype="<u4") for i in range(a, b)]
            got += [(a + x, a + y) for x, y in joining_pairs(wide[a:b], found, part[a:b], similarity)]
        return pairs_of(t, got, "part")

    return ordered(by_list(held.select("g", "rep", "wide", "part", "s"), run, "a binary, b binary"))


def shingle_sets(wanted: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """rep, s (32-bit hashes of the shingles, sorted) of the documents in ``wanted`` (w); ``reps``: rep and a row of it, row (id, h)."""
    one = reps.join(wanted, F.col("rep") == F.col("w"), "left_semi").select(F.col("row.id").alias("i"), F.col("row.h").alias("x"))
    one, _ = materialize(one, "wanted-texts")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(one), (F.col("id") == F.col("i")) & (F.xxhash64("text") == F.col("x")), "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [normal_words(t.as_py()) for t in b.column(1)]
            sets = [np.unique(shingle_set(f, words).astype("<u4")).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(sequence_hash, found)), pa.binary()), pa.array(sets, pa.binary())], ["rep", "s"])

    sets, _ = materialize(texts.mapInArrow(tidy(cut), "rep binary, s binary").groupBy("rep").agg(F.any_value("s").alias("s")), "shingle-sets")
    return sets


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are at least ``similarity`` alike (shared / all)."""
    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [alike(*(np.frombuffer(v.as_buffer(), dtype="<u4") for v in (x, y)), similarity) for x, y in zip(b.column(2), b.column(3), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(k).filter(mask) for k in (0, 1)], ["a", "b"])

    return both.mapInArrow(tidy(run), "a binary, b binary")
