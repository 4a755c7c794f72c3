"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of sampled text.
A document is cut into chunks that cover all of it; each chunk is compressed
with each dictionary, and the language with the smallest total wins.  A narrow
margin between the two smallest totals rejects the decision.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and are rejected; a text whose margin is narrow keeps its best language, with
``accepted`` false; ties go to the language that sorts first; without training
rows every document is ``und``; an empty table gives an empty result; repeated
rows are identified alike; texts of any length are compressed whole; other
columns pass by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import fold, materialize, small, tidy

RESULT_TYPE = "lang_pred string, score double, accepted boolean, margin double"
WORD = re.compile(r"[^\W\d_]+")
#: Pieces of sampled texts that make the dictionary of a language, characters of each, and bytes of a dictionary.
TRAIN_PIECES, PIECE_CHARS, DICT_BYTES = 150, 1_500, 96_000
#: The least bytes that a raw-content dictionary may have.
LEAST_BYTES = 8


def letters(text: str) -> bytes:
    """The lower-cased words of a text, without digits, marks and symbols."""
    return " ".join(WORD.findall(text.lower())).encode("utf-8", "replace")


@dataclass
class LanguageModel:
    dictionaries: dict[str, bytes]
    chunk: int = 4096
    level: int = 9
    min_margin: float = 0.005
    und: str = "und"
    _tools: list | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def tools(self) -> list:
        if self._tools is None:
            self._tools = []
            for name in sorted(self.dictionaries):
                d = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                params = zstandard.ZstdCompressionParameters.from_level(self.level, write_content_size=False, write_checksum=False, write_dict_id=False)
                self._tools.append((name, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
        return self._tools

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text by language, less the fixed frame bytes."""
        data = letters(text)
        parts = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)]
        return np.array([sum(len(c.compress(p)) for p in parts) - 9 * len(parts) for _, c in self.tools()], dtype=float)

    def classify(self, text: str | None) -> tuple[str, float, bool, float]:
        if text is None or not self.dictionaries or not any(map(str.isalpha, text)):
            return self.und, 0.0, False, 0.0
        size = np.maximum(self.sizes(text), 1)
        order = np.argsort(size, kind="stable")
        best = self.tools()[order[0]][0]
        if len(order) == 1:
            return best, 1.0, True, 1.0
        a, b = size[order[0]], size[order[1]]
        margin = float((b - a) / b)
        # bytes saved against each other language, as evidence; bounded so that long texts don't all reach 1
        share = np.exp(-(size - a) / (0.02 * a + 3))
        return best, float(1 / share.sum()), margin >= self.min_margin, margin


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n: int = 3, held: int = 1) -> LanguageModel:
    """Dictionaries from documents outside the held-out fold, each by its own language's rows alone.

    Texts are cut into pieces of PIECE_CHARS characters, and TRAIN_PIECES pieces
    a language are chosen by a hash of id and place, so every part of every text
    can be one; row_number() with such a bound is cut on the map side, so a
    language with most rows is never gathered in one task.  The pieces fill
    DICT_BYTES at most.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold("id", n, held)
    )
    last = F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / PIECE_CHARS).cast("int")
    size, _ = materialize(rows.groupBy("lang").agg(F.sum(last + 1).alias("pieces")), "pieces-of-languages")
    # a hash thins the pieces of each language to a few times the sample before the ranks are given
    places = rows.select("lang", "id", F.xxhash64("text").alias("h"), F.explode(F.sequence(F.lit(0), last)).alias("no")).join(small(size), "lang")
    places = places.where(F.pmod(F.xxhash64("id", "no"), F.lit(1_000_000)) * F.col("pieces") <= F.lit(4_000_000 * TRAIN_PIECES))
    # the order holds the text's hash only; the piece itself is fetched for the chosen places
    w = Window.partitionBy("lang").orderBy(F.xxhash64("id", "no"), "id", "no", "h")
    few = places.select("lang", "id", "h", "no").distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= TRAIN_PIECES)
    few = few.select(F.col("lang").alias("l"), F.col("id").alias("i"), F.col("h").alias("x"), "no", "k")
    few, _ = materialize(few, "pieces-chosen")
    same = (F.col("lang") == F.col("l")) & F.col("id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("x"))
    piece = F.substring("text", F.col("no") * PIECE_CHARS + 1, F.lit(PIECE_CHARS))
    got = rows.join(small(few), same).select("lang", "k", piece.alias("piece")).groupBy("lang", "k").agg(F.min("piece").alias("piece")).collect()
    by: dict[str, list] = {}
    for r in got:
        by.setdefault(r.lang, []).append((r.k, r.piece))
    out = {}
    for name in sorted(by):
        data, full = [], 0
        for _, text in sorted(by[name]):
            b = letters(text) + b"\n"
            if full + len(b) > DICT_BYTES:
                break
            data.append(b)
            full += len(b)
        out[name] = b"".join(data).ljust(LEAST_BYTES)
    return LanguageModel(out)


def identified(text: Column, model: LanguageModel) -> Column:
    """Struct column of language, score, margin and whether it is accepted."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [model.classify(None if v is None or v != v else v) for v in s]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "accepted", "margin"]).astype({"score": "float64", "accepted": "bool", "margin": "float64"})

    @F.pandas_udf(RESULT_TYPE)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(of)(batches)

    return look(text)


def reject_unknown(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Keeps the rows whose language is accepted, with their columns."""
    return docs.withColumn("__lf_lang", identified(F.col(text_col), model)["accepted"]).where("__lf_lang").drop("__lf_lang")
