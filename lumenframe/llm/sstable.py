"""Sorted-string-table shards of token ids.

A shard holds documents in key order: data blocks with prefix-compressed keys,
a sparse index (first key and place of each block), a Bloom filter of the keys
and a fixed footer, so one document is found by a binary search of the index
and the read of one block.  A key is the identifier in a form whose bytes sort
as the identifier does; a value is the document's ids, little-endian.

Layout::

    magic | block* | index | bloom | footer (FOOTER.size bytes)
    block: raw length, stored length, crc32 (u32 each), zstandard data
    entry: varint shared, varint unshared, varint value length, key rest, value

Defined cases: a null text is empty (its value is the end id alone); a null id
sorts first; rows with equal ids are all kept, by a hash of the text, then by
the text; rows that are equal in both stand in one shard; texts of any length
are one entry; an empty table writes no shard and reads back as no rows; other
columns, whatever their names, take no part.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import materialize, scratch, tidy
from lumenframe.llm.encoding import encoder

MAGIC = b"LFSST001"
FOOTER = struct.Struct("<QQQQQQBB6x8s")  # index at, size, bloom at, size, entries, ids, id width, hashes
HEAD = struct.Struct("<III")
BLOCK_BYTES = 64 << 10
MANIFEST = "shard int, path string, entries long, ids long, bytes long"


def key_of(ident) -> bytes:
    """Bytes that sort as the identifier: null, integers, then strings."""
    if ident is None:
        return b"\x00"
    if isinstance(ident, str):
        return b"\x02" + ident.encode("utf-8", "surrogatepass")
    return b"\x01" + struct.pack(">Q", (int(ident) + (1 << 63)) & ((1 << 64) - 1))


def ident_of(key: bytes):
    if key[0] == 0:
        return None
    if key[0] == 2:
        return key[1:].decode("utf-8", "surrogatepass")
    return struct.unpack(">Q", key[1:])[0] - (1 << 63)


def put_varint(n: int, out: bytearray) -> None:
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def bloom_places(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    a, b = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(k, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Entries must come in key order; ``close`` gives entries, ids and bytes."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES, bits_per_key: int = 10, level: int = 1):
        self.out, self.width, self.block_bytes, self.bits_per_key = out, width, block_bytes, bits_per_key
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at = self.out.write(MAGIC) or len(MAGIC)
        self.block, self.first, self.last = bytearray(), b"", b""
        self.count = self.entries = self.ids = self.before = 0
        self.index, self.hashes = bytearray(), []

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys must be added in order")
        shared = 0
        if self.count:
            n = min(len(key), len(self.last))
            while shared < n and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        put_varint(shared, self.block)
        put_varint(len(key) - shared, self.block)
        put_varint(len(value), self.block)
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.count += 1
        self.entries += 1
        self.ids += len(value) // self.width
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.count:
            return
        data = self.zstd.compress(bytes(self.block))
        self.out.write(HEAD.pack(len(self.block), len(data), zlib.crc32(data)))
        self.out.write(data)
        put_varint(len(self.first), self.index)
        self.index += self.first
        put_varint(self.at, self.index)
        put_varint(HEAD.size + len(data), self.index)
        put_varint(self.before, self.index)
        self.at += HEAD.size + len(data)
        self.before = self.ids
        self.block, self.count = bytearray(), 0

    def close(self) -> tuple[int, int, int]:
        self._flush()
        bits, k = max(64, self.entries * self.bits_per_key), 7
        table = np.zeros(-(-bits // 8), dtype=np.uint8)
        bits = len(table) * 8
        for i in range(0, len(self.hashes), 1 << 16):
            places = bloom_places(np.array(self.hashes[i : i + (1 << 16)], dtype=np.uint64), bits, k).ravel()
            np.bitwise_or.at(table, (places >> np.uint64(3)).astype(np.int64), (1 << (places & np.uint64(7))).astype(np.uint8))
        index, bloom = bytes(self.index), table.tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, self.width, k, MAGIC))
        self.out.close()
        return self.entries, self.ids, self.at + len(index) + len(bloom) + FOOTER.size


class ShardReader:
    """Reads a shard from a random-access file."""

    def __init__(self, file, size: int):
        self.file = file
        index_at, index_n, bloom_at, bloom_n, self.entries, self.ids, self.width, self.k, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom = np.frombuffer(self._read(bloom_at, bloom_n), dtype=np.uint8)
        data, at = self._read(index_at, index_n), 0
        self.keys, self.places = [], []
        while at < len(data):
            n, at = get_varint(data, at)
            self.keys.append(data[at : at + n])
            at += n
            place, at = get_varint(data, at)
            length, at = get_varint(data, at)
            before, at = get_varint(data, at)
            self.places.append((place, length, before))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        place, length, _ = self.places[i]
        stored = self._read(place, length)
        raw, n, crc = HEAD.unpack_from(stored)
        body = stored[HEAD.size :]
        if len(body) != n or zlib.crc32(body) != crc:
            raise ValueError(f"block {i} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(body, max_output_size=raw), 0, b""
        while at < len(data):
            shared, at = get_varint(data, at)
            own, at = get_varint(data, at)
            size, at = get_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        places = bloom_places(np.array([xxhash.xxh64_intdigest(key)], dtype=np.uint64), len(self.bloom) * 8, self.k)[0]
        return bool(np.all(self.bloom[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8) & 1))

    def get(self, ident) -> list[np.ndarray]:
        """The ids of every entry with this identifier: Bloom filter, index, then blocks."""
        key = key_of(ident)
        if not self.entries or not self.may_hold(key):
            return []
        out = []
        for i in range(max(0, bisect_left(self.keys, key) - 1), bisect_right(self.keys, key)):
            for k, v in self.block(i):
                if k > key:
                    break
                if k == key:
                    out.append(np.frombuffer(v, dtype=f"<u{self.width}").astype(np.int64))
        return out


def filesystem(uri: str):
    """The Arrow file system and path of a folder that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else "file://" + uri.removeprefix("file:"))


def plain_uri(path: str) -> str:
    return "file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path


def write_shards(docs: DataFrame, tokenizer_json: bytes, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the documents' ids as shards in key order; one manifest row for each shard.

    One range exchange by (id, hash of the text) orders the documents; each
    task encodes its range and writes one file.  A file gets its final name
    only when whole, so a task that runs again replaces it.
    """
    spark = docs.sparkSession
    folder = plain_uri(folder or scratch(spark, "shards"))
    model = spark.sparkContext.broadcast(tokenizer_json)
    sorted_docs = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
        .repartitionByRange(F.col("id").asc_nulls_first(), F.col("h"))
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "h", "text").select("id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model.value, end_id)
        shard, writer = TaskContext.get().partitionId(), None
        fs, path = filesystem(folder)
        name, temp = f"{path}/shard-{shard:06d}.sst", f"{path}/.part-{shard:06d}-{uuid.uuid4().hex}"
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.slice(at, 2048)
                for ident, value in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                    if writer is None:
                        fs.create_dir(path, recursive=True)
                        writer = ShardWriter(fs.open_output_stream(temp), enc.width)
                    writer.add(key_of(ident), value)
        if writer is not None:
            entries, ids, size = writer.close()
            fs.move(temp, name)
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/shard-{shard:06d}.sst"], "entries": [entries], "ids": [ids], "bytes": [size]}
            )

    return materialize(sorted_docs.mapInArrow(tidy(write), MANIFEST), "manifest")[0]


def read_shards(manifest: DataFrame, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """Every document of the shards: id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, over all shards; only
    the manifest, a row for each shard, is summed up in one place.
    """
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("shard", "path", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("base"))
    n = max(1, min(manifest.count(), 10_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    reader = ShardReader(f, f.size())
                    rows: list[tuple] = []
                    for key, value in reader.scan():
                        ids = np.frombuffer(value, dtype=f"<u{reader.width}")
                        rows.append((ident_of(key), base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                        if len(rows) >= 5_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        a, s, n_, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(s, pa.int64()), pa.array(n_, pa.int64()), pa.array(c, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    return based.repartitionByRange(n, "shard").mapInArrow(tidy(read), f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def lookup(manifest_row_path: str, ident) -> list[np.ndarray]:
    """The ids of one identifier in one shard."""
    fs, path = filesystem(manifest_row_path)
    with fs.open_input_file(path) as f:
        return ShardReader(f, f.size()).get(ident)


def from_bytes(data: bytes) -> ShardReader:
    return ShardReader(io.BytesIO(data), len(data))
