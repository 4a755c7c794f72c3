"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A text is cut into sections at blank lines, a section into paragraphs at line
ends, and a paragraph into phrases at blanks after a mark.  A phrase's leaf is
its SHA-256, a paragraph's node the SHA-256 of its leaves, a section's that of
its paragraphs' nodes, and the root that of the sections' nodes.  So equal
roots mean equal texts, and texts that differ do so in the sections and
paragraphs whose nodes differ: only those branches are looked into.

A fingerprint is the root, a colon, and a sketch of the leaves: the SKETCH
smallest of their distinct values, LEAF hex digits each (all of them, if there
are fewer).  It has a bounded size and holds all that likeness needs.  All of
it is DataFrame operations.

Likeness of two fingerprints is 2 * common / (leaves of one + leaves of the
other) over distinct leaves: exact where both sketches are whole, else taken
from the share of the smallest values of both that both have (a standard error
of 0.03 at most); 1 exactly if the roots are equal.  Defined cases: a null text
is empty; an empty text is one empty phrase; two empty texts are equal
(likeness 1); equal ids, of any type that can be ordered, follow by a hash of
the text, then by the text; a null id sorts first; of one document, the next is
itself; repeated rows are documents of their own; texts of any length are taken
whole; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.windows import cut_points, range_number

PHRASE = r"(?<=[.,;:!?|]) "
#: Leaves of a sketch, and hex digits of each; hex digits of a root.
SKETCH, LEAF, ROOT = 256, 8, 64


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf_tree(text: Column) -> Column:
    """Sections of paragraphs of leaves."""
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(F.split(p, PHRASE), sha)))


def paragraph_nodes(tree: Column) -> Column:
    """Sections of paragraphs' nodes."""
    return F.transform(tree, lambda s: F.transform(s, lambda p: sha(F.array_join(p, ""))))


def section_nodes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: sha(F.array_join(s, "")))


def root(sections: Column) -> Column:
    """The root, in lower-case hex."""
    return sha(F.array_join(sections, ""))


def sketch(tree: Column) -> Column:
    """The smallest distinct leaf values, sorted."""
    values = F.array_distinct(F.transform(F.flatten(F.flatten(tree)), lambda x: F.left(x, F.lit(LEAF))))
    return F.slice(F.array_sort(values), 1, SKETCH)


def fingerprint(root_: Column, sketch_: Column) -> Column:
    return F.concat(root_, F.lit(":"), F.array_join(sketch_, ""))


def likeness_of_sketches(a: Column, b: Column, same: Column) -> Column:
    """From two sketches, and whether the roots are equal."""
    whole = (F.size(a) < SKETCH) & (F.size(b) < SKETCH)
    union = F.array_union(a, b)
    least = F.when(whole, union).otherwise(F.slice(F.array_sort(union), 1, SKETCH))
    shared = F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least)
    return F.when(same, F.lit(1.0)).otherwise(F.least(2.0 * shared / (1.0 + shared), 1 - 1.0 / (F.size(a) + F.size(b) + 1)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1."""
    values = lambda fp: F.regexp_extract_all(F.substring(fp, F.lit(ROOT + 2), F.length(fp)), F.lit(f".{{{LEAF}}}"), F.lit(0))
    return likeness_of_sketches(values(a), values(b), F.left(a, F.lit(ROOT)) == F.left(b, F.lit(ROOT)))


def tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, root, sections: array of (node, paragraphs) - the whole tree above the leaves."""
    rows = docs.select(F.col(id_col), leaf_tree(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    rows = rows.select(id_col, paragraph_nodes(F.col("t")).alias("p"))
    rows = rows.select(id_col, "p", section_nodes(F.col("p")).alias("s"))
    return rows.select(id_col, root(F.col("s")).alias("root"), F.zip_with("s", "p", lambda s, p: F.struct(s.alias("node"), p.alias("paragraphs"))).alias("sections"))


def differing(a: Column, b: Column) -> Column:
    """Where two trees' ``sections`` differ: array of (section, paragraph) numbers from 0.

    Only branches with different nodes are looked into.
    """
    n = F.greatest(F.size(a), F.size(b))
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def within(i: Column) -> Column:
        p, q = F.get(a, i)["paragraphs"], F.get(b, i)["paragraphs"]
        m = F.greatest(F.coalesce(F.size(p), F.lit(0)), F.coalesce(F.size(q), F.lit(0)))
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), lambda j: ~F.get(p, j).eqNullSafe(F.get(q, j))), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    return F.flatten(F.transform(F.filter(numbers, lambda i: ~F.get(a, i)["node"].eqNullSafe(F.get(b, i)["node"])), within))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """id, text, next_text: the text of the next document by id; after the last comes the first.

    Ids, and hashes of the texts where ids are equal, are cut into even ranges
    at points taken from a sample once (as many as shuffle partitions), so any
    type of id is spread alike.  The first document of each range is sent to
    the range before it as well, so every range finds its successors alone: one
    exchange of the texts, a range to each partition, and no window over the
    whole table.
    """
    spark = docs.sparkSession
    parts, items = parts or int(spark.conf.get("spark.sql.shuffle.partitions")), [("id", "asc", "first"), "h"]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cuts = cut_points(rows, items, parts)
    rows = rows.withColumn("part", range_number(items, cuts, rows.schema))
    # ids and hashes only: the first row of each range that has rows, and the range it also goes to
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "h")
    firsts = sorted((r.part, r.f) for r in rows.groupBy("part").agg(F.min(order).alias("f")).collect())
    kind = rows.schema["id"].dataType.simpleString()
    heads = spark.createDataFrame([(p, firsts[i - 1][0], f["id"], f["h"]) for i, (p, f) in enumerate(firsts)], f"hpart int, to int, hid {kind}, hh long")  # the first range's goes to the last
    same = (F.col("part") == F.col("hpart")) & F.col("id").eqNullSafe(F.col("hid")) & (F.col("h") == F.col("hh"))
    sent = rows.join(F.broadcast(heads), same).groupBy("to", "id", "h").agg(F.min("text").alias("text"))  # heads: a row for each range
    both = rows.select("part", "id", "h", "text", F.lit(0).alias("end")).unionAll(sent.select(F.col("to").alias("part"), "id", "h", "text", F.lit(1).alias("end")))
    w = Window.partitionBy("part").orderBy("end", F.col("id").asc_nulls_first(), "h", "text")
    dealt = both.repartitionById(len(cuts) + 1, "part")
    return dealt.select("id", "text", "end", F.lead("text").over(w).alias("next_text")).where("end = 0").select("id", "text", "next_text")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and its edited text, their likeness, and how many paragraphs differ.

    The edited text has its last half replaced by the beginning of the next
    document, as many characters or all there are.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n", F.char_length("text"))
    cut = F.expr("int(floor(n / 2))")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n") - cut), F.left("next_text", cut)))
    texts = {"a": "text", "b": "edited", "c": "next_text"}
    rows = rows.select("id", F.col("n").cast("long").alias("n"), sha(F.col("edited")).alias("edited_sha256"), (F.col("text") == F.col("next_text")).alias("same"), *[leaf_tree(F.col(c)).alias(f"{k}t") for k, c in texts.items()])
    rows = rows.select("id", "n", "edited_sha256", "same", *[sketch(F.col(f"{k}t")).alias(f"{k}k") for k in texts], *[paragraph_nodes(F.col(f"{k}t")).alias(f"{k}p") for k in "ab"])
    rows = rows.select("*", *[section_nodes(F.col(f"{k}p")).alias(f"{k}s") for k in "ab"])
    sections = [F.zip_with(f"{k}s", f"{k}p", lambda s, p: F.struct(s.alias("node"), p.alias("paragraphs"))) for k in "ab"]
    rows = rows.select("*", *[root(F.col(f"{k}s")).alias(f"{k}r") for k in "ab"], *[x.alias(f"{k}n") for k, x in zip("ab", sections, strict=True)])
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256",
        fingerprint(F.col("ar"), F.col("ak")).alias("fingerprint"), fingerprint(F.col("br"), F.col("bk")).alias("edited_fingerprint"),
        likeness_of_sketches(F.col("ak"), F.col("bk"), F.col("ar") == F.col("br")).alias("near_edited"),
        likeness_of_sketches(F.col("ak"), F.col("ck"), F.col("same")).alias("near_next"),
        F.size(differing(F.col("an"), F.col("bn"))).cast("long").alias("differing_paragraphs"),
    )
