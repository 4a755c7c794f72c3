"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut at every ``capacity`` ids; those full pieces are
windows of their own.  What remains of it is cut into pieces of at most
``grain`` ids, or of ``fine_grain`` ids towards the end of a bundle.  Pieces are gathered into bundles of a fixed number of windows'
worth of ids and each bundle is split by largest differencing: every piece
starts as a partial partition of m windows, the two partial partitions with
the largest imbalance are merged with opposing order, and so on until one is
left, which has windows of near-equal size.  If one exceeds the capacity, m
rises by one and the bundle is split again.

Bundles are made within a scan partition: nothing is shuffled, memory is
bounded by a bundle and a document, and the last bundle of a partition is the
only one that may be smaller.

Defined cases: a null or empty text is its end id; repeated rows and ids are
packed each; texts of any length are packed whole; pieces of equal size go by
their order in the bundle; an empty table gives no pieces; other columns,
whatever their names, take no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import tidy
from lumenframe.llm.encoding import encoder

CAPACITY, WINDOWS, GRAIN, SLACK = 2048, 64, 700, 4
#: The last ids of a bundle come in fine pieces, which even out what the coarse ones leave.
FINE, FINE_GRAIN = 768, 8


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Splits the items into m groups of near-equal sums; each group lists item numbers."""
    if m == 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(m - 1)]
    # a partial partition lists its windows that hold items, largest first; the others of the m are empty
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie, largest_first = len(sizes), lambda t: -t[0]
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        alone_a, alone_b = m - len(b), m - len(a)  # windows that meet an empty one
        if alone_a >= len(a):
            merged = sorted(a + b, key=largest_first)
        else:
            both = [(x + y, (p, q)) for (x, p), (y, q) in zip(a[alone_a:], reversed(b[alone_b:]), strict=True)]
            merged = sorted(a[:alone_a] + both + b[:alone_b], key=largest_first)
        low = merged[-1][0] if len(merged) == m else 0
        if low:
            merged = [(s - low, g) for s, g in merged]
        heapq.heappush(heap, (-merged[0][0], tie, merged))
        tie += 1
    out = []
    for _, g in heap[0][2]:
        items, todo = [], [g]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out + [[] for _ in range(m - len(out))]


def split_bundle(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their number rises until all fit."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, m)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        m += 1


class Packer:
    """Gathers pieces and gives finished rows."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, windows: int = WINDOWS, grain: int = GRAIN, slack: int = SLACK, fine: int = FINE, fine_grain: int = FINE_GRAIN):
        self.next_id, self.capacity, self.grain = first_id, capacity, min(grain, capacity)
        self.room = windows * (capacity - slack)  # a bundle is filled to this exactly, by a cut
        self.fine, self.fine_grain = min(fine, self.room - 1), min(fine_grain, capacity)
        self.pieces: list[tuple] = []
        self.total = 0
        self.rows: list[tuple] = []

    def _piece(self, doc, ids: np.ndarray, start: int, length: int) -> tuple:
        return (doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids))

    def add(self, doc, ids: np.ndarray) -> None:
        """``ids``: all ids of a document, as little-endian u32."""
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self.rows.append((*self._piece(doc, ids, at, self.capacity), self.next_id, 0))
            self.next_id += 1
            at += self.capacity
        while at < n:
            left = n - at
            coarse = self.room - self.fine - self.total  # what the bundle takes before its fine pieces
            grain = self.grain if coarse > 0 else self.fine_grain
            length = min(-(-left // -(-left // grain)), coarse if coarse > 0 else self.room - self.total)
            self.pieces.append(self._piece(doc, ids, at, length))
            self.total += length
            at += length
            if self.total == self.room:
                self.flush()

    def flush(self) -> None:
        for group in split_bundle([p[2] for p in self.pieces], self.capacity) if self.pieces else ():
            offset, joined = 0, None
            for p in (self.pieces[i] for i in group):
                self.rows.append((*p, self.next_id, offset))
                offset += p[2]
            self.next_id += 1
        self.pieces, self.total = [], 0

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer_json: bytes, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece, with its window and its place there.

    ``sequence_id`` holds the scan partition above bit 40, so ids are unique
    without any exchange between tasks.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value, end_id)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        kind = None

        def out() -> pa.RecordBatch:
            cols = zip(*packer.take(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(cols)], names)

        for b in batches:
            kind = b.schema.field(0).type
            for at in range(0, len(b), 2048):
                part = b.slice(at, 2048)
                for doc, value in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                    packer.add(doc, np.frombuffer(value, dtype=enc.dtype).astype("<u4"))
                if len(packer.rows) > 5_000:
                    yield out()
        packer.flush()
        if packer.rows:
            yield out()

    return rows.mapInArrow(tidy(run), f"{id_col} {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
