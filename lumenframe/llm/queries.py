"""The thin ``opN_<name>`` queries: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import language, linededup, merkle, packing, pieces, quality, simhash, sstable, topk, toxicity
from lumenframe.llm.common import fold, table
from lumenframe.llm.encoding import read_tokenizer

END_ID = 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    got = docs.select("doc_id", quality.scored(F.col("text"), model).alias("score"))
    return got.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text written as shards and read back: doc_id, start, n_tokens, ids_crc32."""
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), read_tokenizer(tokenizer_path("word_bpe_49k.json")), END_ID)
    return sstable.read_shards(manifest)


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return merkle.compared(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: doc_id, fingerprint, component_id."""
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), read_tokenizer(tokenizer_path("byte_bpe_50k.json")), END_ID)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text, decoded again: doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip."""
    model = read_tokenizer(tokenizer_path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    got = pieces.decoded(pieces.encoded(docs, model, carry=("text_sha256",)), model)
    got = pieces.digests(got).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return got.select("doc_id", "n_tokens", "ids_crc32", "decoded_sha256", (F.col("decoded_sha256") == F.col("text_sha256")).alias("round_trip"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score, predicted and counts of hits."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    got = docs.select("doc_id", toxicity.scored(F.col("text"), model).alias("r"))
    return got.select(
        "doc_id", fold("doc_id", 4, 2).alias("held_out"), F.col("r.score").alias("score"), (F.col("r.score") >= 0.3).cast("int").alias("predicted"),
        F.col("r.hits").alias("hits"), F.col("r.fuzzy_hits").alias("fuzzy_hits"), F.col("r.quoted_hits").alias("quoted_hits"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every document: doc_id, n_lines, n_removed, n_chars and sha256 of what stays."""
    got = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("__lf_lines").alias("n_lines"), F.col("__lf_removed").alias("n_removed"), F.char_length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score and whether it is accepted."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    got = docs.select("doc_id", language.identified(F.col("text"), model).alias("r"))
    return got.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "r.lang_pred", "r.score", "r.accepted", "r.margin")


QUERIES = {f.__name__: f for f in (op1_quality, op2_sstable, op3_merkle, op4_topk, op5_simhash, op6_packing, op7_pieces, op8_toxicity, op9_line_dedup, op10_language)}
_TREE = """list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p:
    list_transform(string_split(regexp_replace(p, '([.,;:!?|]) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: sha256(x))))"""
_PARAGRAPHS = "list_transform({0}, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, ''))))"
_SECTIONS = "list_transform({0}, lambda s: sha256(array_to_string(s, '')))"
_SKETCH = f"list_sort(list_distinct(list_transform(flatten(flatten({{0}})), lambda x: left(x, {merkle.LEAF}))))[1:{merkle.SKETCH}]"
_LEAST = f"CASE WHEN len({{0}}) < {merkle.SKETCH} AND len({{1}}) < {merkle.SKETCH} THEN list_distinct({{0}} || {{1}}) ELSE list_sort(list_distinct({{0}} || {{1}}))[1:{merkle.SKETCH}] END"
_SHARED = "CAST(len(list_intersect({2}, list_intersect({0}, {1}))) AS DOUBLE) / len({2})"
_LIKE = "CASE WHEN {3} THEN 1.0 ELSE least(2.0 * {2} / (1.0 + {2}), 1 - 1.0 / (len({0}) + len({1}) + 1)) END"
_DIFFERING = """coalesce(list_sum(list_transform(range(1, greatest(len(sa), len(se)) + 1), lambda i: CASE WHEN sa[i] IS NOT DISTINCT FROM se[i] THEN 0 ELSE
    len(list_filter(range(1, greatest(coalesce(len(pa[i]), 0), coalesce(len(pe[i]), 0)) + 1), lambda j: pa[i][j] IS DISTINCT FROM pe[i][j])) END)), 0)"""
ORACLES: dict[str, str] = {
    "op3_merkle": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text, length(text) AS n FROM t),
        e AS (SELECT *, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM n),
        h AS (SELECT doc_id, n, text, next_text, edited, {_TREE.format("text")} AS ta, {_TREE.format("edited")} AS te, {_TREE.format("next_text")} AS tn FROM e),
        k AS (SELECT *, {_SKETCH.format("ta")} AS ka, {_SKETCH.format("te")} AS ke, {_SKETCH.format("tn")} AS kn, {_PARAGRAPHS.format("ta")} AS pa, {_PARAGRAPHS.format("te")} AS pe FROM h),
        m AS (SELECT *, {_SECTIONS.format("pa")} AS sa, {_SECTIONS.format("pe")} AS se, {_LEAST.format("ka", "ke")} AS le, {_LEAST.format("ka", "kn")} AS ln FROM k),
        r AS (SELECT *, sha256(array_to_string(sa, '')) AS ra, sha256(array_to_string(se, '')) AS re, {_SHARED.format("ka", "ke", "le")} AS je, {_SHARED.format("ka", "kn", "ln")} AS jn FROM m)
        SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, ra || ':' || array_to_string(ka, '') AS fingerprint, re || ':' || array_to_string(ke, '') AS edited_fingerprint,
               CAST({_LIKE.format("ka", "ke", "je", "ra = re")} AS DOUBLE) AS near_edited, CAST({_LIKE.format("ka", "kn", "jn", "text = next_text")} AS DOUBLE) AS near_next,
               CAST({_DIFFERING} AS BIGINT) AS differing_paragraphs
        FROM r
    """,
    "op9_line_dedup": f"""
        WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
        raws AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS no FROM parts),
        lines AS (SELECT doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM raws),
        firsts AS (SELECT line, min(ROW(doc_id, no)) AS pos FROM lines WHERE line <> '' GROUP BY line),
        long AS (SELECT * FROM firsts WHERE length(line) >= {linededup.EDIT_CHARS}),
        cut AS (SELECT line, pos, i, left(line, i) || substring(line, i + 2) AS v FROM (SELECT line, pos, unnest(range(length(line))) AS i FROM long) AS x),
        near AS (
            SELECT a.line FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i WHERE a.line <> b.line AND b.pos < a.pos
            UNION SELECT a.line FROM cut a JOIN long b ON a.v = b.line WHERE b.pos < a.pos
            UNION SELECT b.line FROM cut a JOIN long b ON a.v = b.line WHERE a.pos < b.pos
        ),
        marked AS (
            SELECT l.doc_id, l.no, l.raw, f.line IS NOT NULL AND (n.line IS NOT NULL OR ROW(l.doc_id, l.no) > f.pos) AS gone
            FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line
        ),
        kept AS (SELECT doc_id, count(*) AS n_lines, sum(CAST(gone AS INTEGER)) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, length(k.text) AS n_chars_kept, sha256(k.text) AS kept_sha256
        FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
