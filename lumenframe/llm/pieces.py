"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

All pieces of a SentencePiece model stand in one Aho-Corasick automaton.  A
single pass over a text follows its output links: every piece that ends at a
position relaxes the best score there, so the pass ends with the segmentation
of highest total score (of equal ones, the one whose last pieces are longer).
A character that isn't a piece by itself may also become byte pieces, at a score
below any piece.

A blank is the mark U+2581, and a text starts with one.  No piece of the usual
models has the mark after another character, so units between such places are
independent; each is segmented once and kept.  Where a model has such pieces,
whole texts are units.  A mark that stands in the text itself becomes bytes,
and nothing is normalised, so decoding gives back every text exactly.

Defined cases: a null or empty text has no ids and decodes as empty; ids that
aren't pieces raise; bytes that aren't UTF-8 decode as U+FFFD; repeated rows are
encoded each; an empty table gives an empty result; texts of any length are
encoded whole; a carried column named ``ids`` or ``decoded`` gives way to the
result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import tidy

MARK = "▁"
#: Stands for a mark of the text itself while it is segmented; in no piece.
OWN_MARK = "﷐"
UNKNOWN_PENALTY = 10.0
#: Characters of the units that a worker keeps.
KEEP_CHARS = 5_000_000
UNITS = re.compile(r"\n| +[^ \n]*|[^ \n]+")


class PieceModel:
    """Pieces of a SentencePiece model and the units segmented so far."""

    def __init__(self, model: bytes, keep: int = KEEP_CHARS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.automaton, self.keep, self.seen = ahocorasick.Automaton(), keep, {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.single: set[str] = set()
        self.kept = 0  # characters of the units seen
        least, spans = 0.0, False
        for i in range(sp.get_piece_size()):
            piece, out = sp.id_to_piece(i), b""
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                out = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                score = sp.get_score(i)
                least = min(least, score)
                self.automaton.add_word(piece, (len(piece), i, score))
                if len(piece) == 1:
                    self.single.add(piece)
                spans |= MARK in piece.lstrip(MARK) or "\n" in piece
                out = piece.replace(MARK, " ").encode()
            self.bytes_of.append(out)
        self.automaton.make_automaton()
        self.unknown, self.unknown_score = sp.unk_id(), least - UNKNOWN_PENALTY
        self.whole = spans

    def segment(self, raw: str) -> list[int]:
        """Ids of the best segmentation of a unit, with blanks as they are."""
        text, n = raw.replace(MARK, OWN_MARK).replace(" ", MARK), len(raw)
        best, via = [0.0] + [None] * n, [None] * (n + 1)
        done, unknown, single = 0, self.unknown_score, self.single
        for end, (size, piece, score) in self.automaton.iter(text):
            while done <= end:  # no piece is one character here: the step over it is always open
                if text[done] not in single:
                    best[done + 1] = best[done] + unknown
                done += 1
            value = best[end + 1 - size] + score
            held = best[end + 1]
            if held is None or value > held or (value == held and via[end + 1] is None):
                best[end + 1], via[end + 1] = value, (size, piece)
        while done < n:
            best[done + 1] = best[done] + unknown
            done += 1
        out, at = [], n
        while at:
            if via[at] is None:
                at -= 1
                out += [self.byte_ids.get(b, self.unknown) for b in reversed(raw[at].encode("utf-8", "surrogatepass"))]
            else:
                size, piece = via[at]
                out.append(piece)
                at -= size
        return out[::-1]

    def _unit(self, unit: str) -> bytes:
        ids = np.array(self.segment(unit), dtype="<u4").tobytes()
        self.seen[unit] = ids
        self.kept += len(unit)
        return ids

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.kept > self.keep:
            self.seen.clear()
            self.kept = 0
        text, known = " " + text, self.seen
        units = [text] if self.whole else UNITS.findall(text)
        try:
            return b"".join([known[u] for u in units])
        except KeyError:
            return b"".join([known[u] if u in known else self._unit(u) for u in units])

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        text = b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_MODELS: dict = {}


def loaded(model: bytes) -> PieceModel:
    """One model for each worker process, so that what it has segmented outlives a task."""
    key = (zlib.crc32(model), len(model))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(model)
    return _MODELS[key]


def encoded(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of ``carry``, and ids (binary, little-endian unsigned 32-bit)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carry = tuple(c for c in carry if c not in (id_col, "ids"))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__lf_text"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(sent.value)
        for b in batches:
            ids = pa.array([pieces.encode(t.as_py()) for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], ids], [id_col, *carry, "ids"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(tidy(run), ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *carry)) + ", ids binary")


def decoded(rows: DataFrame, model: bytes) -> DataFrame:
    """All columns, and the text that ``ids`` stand for as ``decoded``."""
    sent, rows = rows.sparkSession.sparkContext.broadcast(model), rows.drop("decoded")
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(sent.value)
        for b in batches:
            texts = pa.array([pieces.decode(v.as_py() or b"") for v in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "decoded"])

    return rows.mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string")


def digests(rows: DataFrame) -> DataFrame:
    """Adds n_tokens and ids_crc32."""
    return rows.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).withColumn("ids_crc32", F.crc32("ids"))
