"""Corpus cleaning pipeline: the stages in order, each of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import language, linededup, packing, simhash, toxicity
from lumenframe.llm.common import materialize, remove, table, temporary
from lumenframe.llm.encoding import read_tokenizer
from lumenframe.llm.queries import END_ID, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (operator 8): documents that it rejects go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (operator 10): documents that it rejects go."""
    return language.reject_unknown(docs, language.train(table(spark, sf_dir, "documents")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (operator 9): repeated and nearly repeated lines go, documents stay."""
    return linededup.dedup_lines(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (operator 5): one document of each group stays."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (operator 6): the pieces of what is left, in windows."""
    return packing.pack(docs, read_tokenizer(tokenizer_path("byte_bpe_50k.json")), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("packing", packed),
]
#: The stages learn models, so SQL can't express them; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before wrote."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark) as written:  # what the stage needed goes once its result is there
            docs, path = materialize(stage(spark, docs, sf_dir), name)
            written.discard(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
