"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line that isn't blank goes if an earlier line, by (document id, line number),
is equal to it, or, where both have ``edit_chars`` characters at least, within
one edit (a character inserted, deleted or replaced): among shorter lines one
character makes another word.  Two lines are
within one edit exactly if they share a variant: a line itself, or a line less
one character.

1.  Equal lines are pre-aggregated to one row with the earliest place.
2.  Only lines that can have a partner emit variants: of two lines within one
    edit, the first or the last half of the shorter length is the same.  Each
    distinct line gives four hashed half keys; lines whose keys nobody shares
    are out, without loss, and a shared half also says which positions the
    edit can take.
3.  Variants are hashed in constant time each: the hash of a line is a sum over
    its characters (by position, for replacements) or over its pairs of
    neighbours (for deletions), so a variant's hash takes a few sums.
4.  Equal variants are joined.  Lines that are equal but for position i are
    within one edit of each other, so each is held against the earliest only; a
    line less one character is held against the line that equals it.  No group
    is expanded into pairs.
5.  Every pair is verified by its edit distance.

Defined cases: null and empty texts have no lines to remove; blank lines always
stay; lines of any length and number take part; equal ids (repeated rows) are
one document, so their copies of a line at one place all stay; a null id sorts
first; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import materialize, small

#: Characters, after trimming, from which lines are compared by edits; shorter ones by equality.
EDIT_CHARS = 16
BLANKS = " \t\r\x0b\x0c"


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and gives it to ``body``."""
    return F.transform(F.array(value), body)[0]


def h32(*cols: Column) -> Column:
    """A hash of 32 bits, so that sums over a line can't overflow."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 32)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that take part: id, no, line (trimmed), n, h1, h2."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "raw"))
    rows = rows.select("id", "no", F.btrim("raw", F.lit(BLANKS)).alias("line"))
    rows = rows.withColumn("n", F.char_length("line")).where("n > 0")
    return rows.select("id", "no", "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"))


def half_keys(edit_chars: int) -> list[Column]:
    """Of lines that are compared by edits, keys of the first and last half, for the line as the shorter one (role 0) and as the longer one (role 1)."""
    out = []
    for role in (0, 1):
        m = F.col("n") - role
        half = F.expr(f"int((n - {role}) / 2)")
        for kind, part in (("first", F.left("line", half)), ("last", F.right("line", half))):
            out.append(F.when(F.col("n") >= edit_chars, F.xxhash64(F.lit(kind), m, part)).alias(f"{kind}{role}"))
    return out


def near_lines(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier line within one edit."""
    keys = distinct.select(
        "h1", "h2", "id", "no", "n",
        F.explode(F.array(*[F.struct(F.col(f"{kind}{role}").alias("key"), F.lit(kind == "first").alias("front"), F.lit(role).alias("role")) for kind in ("first", "last") for role in (0, 1)])).alias("k"),
    ).select("h1", "h2", "id", "no", "n", "k.key", "k.front", "k.role")
    own = F.when(F.col("role") == 0, F.col("h1"))
    shared = (
        keys.groupBy("key").agg(F.min(own).alias("a"), F.max(own).alias("b"), F.max("role").alias("longer"))
        .select("key", (F.col("a") != F.col("b")).alias("same"), (F.col("a").isNotNull() & (F.col("longer") == 1)).alias("apart"))
        .where("same or apart")
    )
    flag = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    front, role = F.col("front"), F.col("role")
    candidates = (
        keys.join(shared, "key").groupBy("h1", "h2", "id", "no", "n")
        .agg(
            flag(F.col("same") & (role == 0) & front).alias("swap_back"), flag(F.col("same") & (role == 0) & ~front).alias("swap_front"),
            flag(F.col("apart") & (role == 1) & front).alias("cut_back"), flag(F.col("apart") & (role == 1) & ~front).alias("cut_front"),
            flag(F.col("apart") & (role == 0)).alias("base"),
        )
    )
    candidates, _ = materialize(candidates, "line-candidates")
    texts = (
        lines.select("id", "no", "line", "h1", "h2").alias("l")
        .join(small(candidates.withColumnsRenamed({"id": "cid", "no": "cno", "h1": "c1", "h2": "c2"})), F.col("l.id").eqNullSafe(F.col("cid")) & (F.col("l.no") == F.col("cno")) & (F.col("l.h1") == F.col("c1")) & (F.col("l.h2") == F.col("c2")))
        .select("id", "no", "line", "n", "h1", "h2", "swap_back", "swap_front", "cut_back", "cut_front", "base")
        .dropDuplicates(["h1", "h2"])
    )
    texts, _ = materialize(texts, "line-texts")
    me = F.struct("id", "no", "h1").alias("me")
    chars = F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0))
    n, none = F.col("n"), F.lit("")

    def swaps(c: Column) -> Column:  # positions count from 0
        def variants(p: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.when(i >= F.expr("int(n / 2)"), F.col("swap_back")).otherwise(F.lit(False)) | F.when(i < n - F.expr("int(n / 2)"), F.col("swap_front")).otherwise(F.lit(False)))
            return let(total(p), lambda s: F.transform(at, lambda i: F.xxhash64(F.lit(0), n, i, s - F.get(p, i))))

        return let(F.transform(c, lambda x, i: h32(i, x)), variants)

    def pair(c: Column, a: Column, b: Column) -> Column:  # c: the line between two empty strings
        return h32(F.get(c, a), F.get(c, b))

    def neighbours(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n), lambda j: pair(c, j, j + 1))

    def cuts(c: Column) -> Column:
        half = F.expr("int((n - 1) / 2)")
        at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i >= half) & F.col("cut_back")) | ((i < n - half) & F.col("cut_front")))
        return let(neighbours(c), lambda g: let(total(g), lambda s: F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.lit(1), n - 1, s - F.get(g, i) - F.get(g, i + 1) + pair(c, i, i + 2))))))

    framed = F.concat(F.array(none), chars, F.array(none))
    swapped = texts.where("swap_back or swap_front").select(me, F.explode(let(chars, swaps)).alias("key"))
    earliest = swapped.groupBy("key").agg(F.min("me").alias("first"), F.max("me").alias("last")).where(F.col("first") != F.col("last")).select("key", "first")
    pairs = swapped.join(earliest, "key").where(F.col("me") > F.col("first")).select(F.col("me.h1").alias("a"), F.col("first.h1").alias("b"))
    cut = texts.where("cut_back or cut_front").select(F.col("h1").alias("a"), F.explode(let(framed, cuts)).alias("key"))
    whole = texts.where("base").select(F.col("h1").alias("b"), F.xxhash64(F.lit(1), n, let(framed, lambda c: total(neighbours(c)))).alias("key"))
    pairs = pairs.unionByName(cut.join(whole, "key").select("a", "b")).distinct()
    side = lambda p: texts.select(F.col("h1").alias(p), F.struct("id", "no", "h1").alias(f"{p}_at"), F.col("line").alias(f"{p}_line"), F.col("h2").alias(f"{p}_h2"))
    checked = pairs.join(side("a"), "a").join(side("b"), "b").where(F.levenshtein("a_line", "b_line", 1) == 1)
    later = F.col("a_at") > F.col("b_at")
    return checked.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("h1"), F.when(later, F.col("a_h2")).otherwise(F.col("b_h2")).alias("h2")).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_chars: int = EDIT_CHARS, max_edits: int = 1) -> DataFrame:
    """One row for each document that loses lines: __lf_id, __lf_gone (array of (no, h1))."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    lines = lines_of(docs, id_col, text_col)
    distinct = (
        lines.select("h1", "h2", "n", F.struct("id", "no").alias("at"), *half_keys(edit_chars)).groupBy("h1", "h2")
        .agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), *[F.any_value(c).alias(c) for c in ("n", "first0", "first1", "last0", "last1")])
        .select("h1", "h2", F.col("first_at.id").alias("id"), F.col("first_at.no").alias("no"), (F.col("first_at") != F.col("last_at")).alias("again"), "n", "first0", "first1", "last0", "last1")
    )
    distinct, _ = materialize(distinct, "lines")
    if max_edits:
        near = near_lines(lines, distinct.where(F.col("n") >= edit_chars)).withColumn("near", F.lit(True))
        marked = distinct.select("h1", "h2", "id", "no", "again").join(near, ["h1", "h2"], "left").where("again or near")
    else:
        marked = distinct.where("again").select("h1", "h2", "id", "no", F.lit(False).alias("near"))
    marked, _ = materialize(marked.select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), F.struct("id", "no").alias("first_at"), F.coalesce("near", F.lit(False)).alias("near")), "lines-marked")
    gone = (
        lines.select("id", "no", "h1", "h2")
        .join(small(marked), (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2")))
        .where(F.col("near") | (F.struct("id", "no") > F.col("first_at")))
    )
    return gone.groupBy(F.col("id").alias("__lf_id")).agg(F.collect_set(F.struct("no", "h1")).alias("__lf_gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_chars: int = EDIT_CHARS, max_edits: int = 1) -> DataFrame:
    """``docs`` with the kept lines as text, and __lf_lines, __lf_removed: counts of lines."""
    gone, _ = materialize(removed_lines(docs, id_col, text_col, edit_chars, max_edits), "lines-gone")
    joined = docs.join(small(gone), F.col(id_col).eqNullSafe(F.col("__lf_id")), "left")

    def kept(parts: Column) -> Column:
        def without(nos: Column) -> Column:
            return F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), nos), lambda i: F.get(parts, i))

        # equal ids with other texts: only the lines meant go
        own = F.filter("__lf_gone", lambda g: F.xxhash64(F.btrim(F.get(parts, g["no"]), F.lit(BLANKS))) == g["h1"])
        return let(F.transform(own, lambda g: g["no"]), without)

    parts = F.split(F.col(text_col), "\n")
    lines = F.when(F.col("__lf_gone").isNotNull() & F.col(text_col).isNotNull(), let(parts, kept))
    n = F.coalesce(F.size(parts), F.lit(0))
    out = joined.withColumn("__lf_kept", lines).withColumn("__lf_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n))
    out = out.withColumn("__lf_removed", F.when(F.col("__lf_kept").isNull(), F.lit(0)).otherwise(F.col("__lf_lines") - F.size("__lf_kept")))
    out = out.withColumn(text_col, F.when(F.col("__lf_kept").isNull(), F.col(text_col)).otherwise(F.array_join("__lf_kept", "\n")))
    return out.select(*docs.columns, "__lf_lines", "__lf_removed")
