"""The ten operators against brute force, exact round trips and stated cases."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("lumenframe.llm")
from pyspark.sql import functions as F  # noqa: E402

from lumenframe.llm import components, language, linededup, merkle, nearcopies, packing, pieces, quality, simhash, sstable, topk, toxicity  # noqa: E402
from lumenframe.llm.encoding import PairEncoder, read_tokenizer  # noqa: E402
from lumenframe.llm.queries import tokenizer_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


_ENC: dict = {}


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS) + str(rng.integers(40)) for _ in range(n))


ODD = [None, "", " \n\t ", "x", "x", "Ünïcode 漢字 🙂", "a\r\nb\n\n\nc  d", "word " * 3000, "<|endoftext|> text", " nbsp em"]


def clashing(df):
    """Extra columns with names that the operators might use inside."""
    for name in ("id", "h", "n", "line", "key", "rep", "fp", "lang_pred", "score"):
        df = df.withColumn(name, F.lit("own"))
    return df


# 1 quality


def test_quality_learns_and_covers_whole_texts(spark):
    rng = np.random.default_rng(3)
    good = [prose(i, 60) + "." for i in range(80)]
    bad = ["".join(rng.choice(list("@#$%&*!~^")) for _ in range(300)) for _ in range(80)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.scored(F.col("text"), model).alias("s")).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 20 and all((got[i] >= 0.7) == (i < 80) for i in held)
    long = "".join(good[:20])
    assert model.features(long)[: 3 * quality.FILTERS] != pytest.approx(model.features(long + bad[0])[: 3 * quality.FILTERS])  # the end counts
    odd = docs_of(spark, ODD).select(quality.scored(F.col("text"), model).alias("s")).collect()
    assert len(odd) == len(ODD) and all(0 <= r.s <= 1 for r in odd)


def test_quality_chunks_agree_with_plain_convolution():
    rng = np.random.default_rng(1)
    model = quality.fit([quality.chunk_windows(prose(i, 30).encode()) for i in range(12)], np.arange(12) % 2)
    for n in (1, 5, 6, 127, 128, 129, 300, 1000):
        data = rng.integers(1, 255, n, dtype=np.uint8).tobytes()
        b = np.frombuffer(data + bytes(max(0, quality.WIDTH - n)), dtype=np.uint8)
        act = np.array([sum(model.table[j, b[i + j]] for j in range(quality.WIDTH)) for i in range(len(b) - quality.WIDTH + 1)])
        blocks = [act[i : i + quality.BLOCK].max(axis=0) for i in range(0, len(act), quality.BLOCK)]
        pooled = [np.maximum(x, y) for x, y in itertools.pairwise(blocks)] if len(blocks) > 1 else blocks
        assert np.allclose(model.pooled(data), np.tanh(np.array(pooled) + model.bias), atol=1e-4)
    for text in (*ODD, prose(3, 700)):  # the whole score, from plain loops
        data = (text or "").encode("utf-8", "replace")
        b = np.frombuffer(data + bytes(max(0, quality.WIDTH - len(data))), dtype=np.uint8)
        act = np.array([sum(model.table[j, b[i + j]] for j in range(quality.WIDTH)) for i in range(len(b) - quality.WIDTH + 1)])
        blocks = [act[i : i + quality.BLOCK].max(axis=0) for i in range(0, len(act), quality.BLOCK)]
        a = np.tanh(np.array([np.maximum(x, y) for x, y in itertools.pairwise(blocks)] if len(blocks) > 1 else blocks) + model.bias)
        short = max(0.0, 1 - len(data) / (2 * quality.BLOCK))
        z = np.concatenate([a.mean(axis=0), a.max(axis=0), a.min(axis=0), [short], short * a.mean(axis=0)])
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-(z @ model.head + model.intercept))), abs=1e-3)


def test_quality_without_labels(spark):
    model = quality.train(docs_of(spark, ["a"]), spark.createDataFrame([], "doc_id long, quality int"))
    assert model.score(["a", None]).tolist() == pytest.approx([0.5, 0.5])
    assert docs_of(spark, []).select(quality.scored(F.col("text"), model)).count() == 0


# 2 sorted-string tables, 6 packing: encoding


KINDS = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def library_ids(enc, text):
    return [*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("file", KINDS)
def test_texts_encode_as_the_library_does(file):
    enc = PairEncoder(read_tokenizer(tokenizer_path(file)), 1)
    assert enc.core is not None
    texts = [*ODD, "I'm here, you're;  not 12345!?\n\n Next\tline .", "a,b|c: d", " lead", "trail ", prose(5, 400), "É́ ﬁ\u200b x", "don't STOP\n\n\n", "\x01\x02 marks", "a\x0bb\x0cc"]
    texts += ["<|endoftext|> in <|startoftext|>", "!'s ''ll'D _x_ 9²½ ŉ İ ẞß ΑΣ", "a" * 40_000, "的一是" * 9_000, "! " * 9_000, "\u00a0nbsp\u2028", "\n" * 5_000]
    for t, v in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(v, dtype=enc.dtype).tolist() == library_ids(enc, t), repr(t)[:80]


@pytest.mark.parametrize("file", KINDS)
def test_every_character_encodes_as_the_library_does(file):
    enc = PairEncoder(read_tokenizer(tokenizer_path(file)), 1)
    letters = [chr(c) for c in [*range(0x3400), *range(0x4DF0, 0x4E60), *range(0x9F90, 0xA000), *range(0xF900, 0x10000, 3), *range(0x10000, 0x20000, 29)]]
    texts = [f"x{c}Y 1{c}2 !{c}? {c} '{c}s {c}{c}  {c}'s" for c in letters]
    want = [[*e.ids, 1] for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(v, dtype=enc.dtype).tolist() for v in enc.encode(texts)]
    assert [hex(ord(c)) for c, a, b in zip(letters, got, want, strict=True) if a != b] == []


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abZéß's tlvrdmeÀ12 \n\t.,;_-|«»“—的、"), max_size=40))
def test_any_mixture_encodes_as_the_library_does(text):
    for file in KINDS:
        enc = _ENC.setdefault(file, PairEncoder(read_tokenizer(tokenizer_path(file)), 1)) if file not in _ENC else _ENC[file]
        assert np.frombuffer(enc.encode([text])[0], dtype=enc.dtype).tolist() == library_ids(enc, text)


def test_other_tokenizers_go_through_the_library():
    import json

    spec = json.loads(read_tokenizer(tokenizer_path("byte_bpe_50k.json")))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}):
        enc = PairEncoder(json.dumps(spec | change).encode(), 1)
        assert enc.core is None
        for t, v in zip(ODD, enc.encode(ODD), strict=True):
            assert np.frombuffer(v, dtype=enc.dtype).tolist() == library_ids(enc, t)


def test_shards_round_trip(spark):
    texts = [*ODD, *[prose(i, 50) for i in range(40)]]
    ids = [i * 7 - 30 for i in range(len(texts))]
    raw = read_tokenizer(tokenizer_path("word_bpe_49k.json"))
    enc = PairEncoder(raw, 1)
    manifest = sstable.write_shards(clashing(docs_of(spark, texts, ids)), raw, 1)
    got, start = {r.doc_id: r for r in sstable.read_shards(manifest).collect()}, 0
    for i, t in sorted(zip(ids, texts, strict=True)):
        want = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
        found = [x.tolist() for r in manifest.collect() for x in sstable.lookup(r.path, i)]
        assert found == [want.tolist()]
    assert all(not sstable.lookup(r.path, 10**9) for r in manifest.collect())


def test_shard_layout_and_damage():
    import io

    class Kept(io.BytesIO):
        def close(self):
            self.whole = self.getvalue()

    out = Kept()
    w = sstable.ShardWriter(out, 2, block_bytes=200)
    keys = [None, *range(-5, 200), "a", "ab", "ab", "b"]
    for i, k in enumerate(keys):
        w.add(sstable.key_of(k), np.array([i, i + 1], dtype="<u2").tobytes())
    with pytest.raises(ValueError):
        w.add(sstable.key_of(3), b"")
    w.close()
    r = sstable.from_bytes(out.whole)
    assert [sstable.ident_of(k) for k, _ in r.scan()] == keys and len(r.places) > 5
    assert [x.tolist() for x in r.get("ab")] == [[keys.index("ab"), keys.index("ab") + 1], [keys.index("ab") + 1, keys.index("ab") + 2]] and r.get("c") == []
    bad = bytearray(out.whole)
    bad[30] ^= 255
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.from_bytes(bytes(bad)).scan())


def test_shards_of_nothing_and_of_repeated_ids(spark):
    raw = read_tokenizer(tokenizer_path("word_bpe_49k.json"))
    assert sstable.read_shards(sstable.write_shards(docs_of(spark, []), raw, 1)).count() == 0
    rows = sstable.read_shards(sstable.write_shards(docs_of(spark, ["b c", "a", None], [5, 5, None]), raw, 1)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 5, 5] and sum(r.n_tokens for r in rows) == rows[-1].start + rows[-1].n_tokens


def test_padding_is_little():
    rng, packer = np.random.default_rng(4), packing.Packer(0)
    for i, n in enumerate(np.minimum(rng.lognormal(6, 1.2, 3_000).astype(int) + 1, 60_000)):
        packer.add(i, np.zeros(n, dtype="<u4"))
    packer.flush()
    rows = packer.take()
    used, windows = sum(r[2] for r in rows), packer.next_id
    assert windows > 400 and used / (windows * packing.CAPACITY) > 0.98
    fill = {}
    for r in rows:
        fill[r[5]] = fill.get(r[5], 0) + r[2]
    assert max(fill.values()) <= packing.CAPACITY and len(fill) == windows


def test_packing(spark):
    texts = [*ODD, *[prose(i, 30 + 37 * i) for i in range(60)]]
    raw = read_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    enc = PairEncoder(raw, 1)
    rows = packing.pack(clashing(docs_of(spark, texts)), raw, 1).collect()
    want = {i: np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in enumerate(texts)}
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[r.doc_id])
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids)
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(docs_of(spark, []), raw, 1).count() == 0


def test_differencing_is_near_equal_and_rises():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 512, 130).tolist()
        groups = packing.differencing(sizes, 16)
        sums = [sum(sizes[i] for i in g) for g in groups]
        assert sorted(i for g in groups for i in g) == list(range(130)) and max(sums) - min(sums) <= 512
    groups = packing.split_bundle([1500, 1500, 1500], 2048)
    assert len(groups) == 3 and packing.split_bundle([5], 2048) == [[0]]


# 3 Merkle trees


def test_merkle(spark):
    texts = ["One. Two.\nThree.\n\nFour.", "One. Two.\nThree!\n\nFour.", None, "", "éé🙂" * 9, "One. Two.\nThree.\n\nFour."]
    rows = {r.doc_id: r for r in merkle.compared(docs_of(spark, texts)).collect()}
    known = [t or "" for t in texts]
    for i, t in enumerate(known):
        nxt, half = known[(i + 1) % len(known)], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (rows[i].fingerprint == rows[i].edited_fingerprint) == (t == edited) and (rows[i].near_next == 1) == (t == nxt)
    assert rows[0].fingerprint == rows[5].fingerprint and rows[2].fingerprint == rows[3].fingerprint and len({r.fingerprint for r in rows.values()}) == 4
    tree = {r.doc_id: r for r in merkle.tree(docs_of(spark, texts)).collect()}
    pair = merkle.tree(docs_of(spark, texts)).where("doc_id = 0").crossJoin(merkle.tree(docs_of(spark, texts)).where("doc_id = 1").select(F.col("sections").alias("other")))
    assert [tuple(d) for d in pair.select(merkle.differing(F.col("sections"), F.col("other")).alias("d")).collect()[0].d] == [(0, 1)]
    assert len(tree[0].sections) == 2 and merkle.compared(docs_of(spark, [])).count() == 0
    one = merkle.compared(docs_of(spark, ["only one here"])).collect()[0]
    assert one.near_next == 1.0


def brute_likeness(a, b):
    def values(text):
        cut = [x for line in text.split("\n") for x in __import__("re").split(merkle.PHRASE, line)]
        return sorted({hashlib.sha256(x.encode()).hexdigest()[: merkle.LEAF] for x in cut})

    if a == b:
        return 1.0
    x, y = (values(t)[: merkle.SKETCH] for t in (a, b))
    least = sorted({*x, *y}) if max(len(x), len(y)) < merkle.SKETCH else sorted({*x, *y})[: merkle.SKETCH]
    j = len(set(least) & set(x) & set(y)) / len(least)
    return min(2 * j / (1 + j), 1 - 1 / (len(x) + len(y) + 1))


@pytest.mark.parametrize("kind", ["long", "string", "decimal(20,2)", "date"])
def test_next_documents_by_any_kind_of_id(spark, kind):
    import datetime
    import decimal

    make = {"long": int, "string": lambda i: f"doc-{i:04d}", "decimal(20,2)": lambda i: decimal.Decimal(f"{i}.50"), "date": lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=i)}[kind]
    rng, texts = np.random.default_rng(2), [". ".join(prose(int(k), 4) for k in range(i, i + 5)) for i in range(160)]
    texts[7] = ". ".join(f"sentence {k} of a long text" for k in range(3_000))
    texts[8] = ". ".join(f"sentence {k} of a long text" for k in range(1_000, 4_000))
    rows = [(make(i), texts[i], "x") for i in rng.permutation(160).tolist()]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, part string").withColumn("end", F.lit(1)).withColumn("h", F.lit(2)).withColumn("id", F.lit(3))
    got = {r.doc_id: r for r in merkle.compared(docs).collect()}
    for i, t in enumerate(texts):
        r, nxt = got[make(i)], texts[(i + 1) % 160]
        assert r.near_next == pytest.approx(brute_likeness(t, nxt)) and r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()
    assert got[make(7)].near_next == pytest.approx(2 / 3, abs=0.1)
    prints = spark.createDataFrame([(r.fingerprint, r.edited_fingerprint, r.near_edited) for r in got.values()], "a string, b string, near double")
    assert all(r.x == pytest.approx(r.near) for r in prints.select("near", merkle.likeness(F.col("a"), F.col("b")).alias("x")).collect())


def test_next_documents_of_repeated_ids(spark):
    texts = ["a", "b", "b", None, "c"] * 8
    got = merkle.with_next(docs_of(spark, texts, [5, 5, 5, None, 9] * 8), parts=4).collect()
    assert len(got) == 40
    order = sorted(((r.id is not None, r.id or 0), r.text) for r in got)
    follow = sorted((r.text, r.next_text) for r in got)
    chain = [t for _, t in order]
    runs = {5: sorted(t for (_, i), t in order if i == 5)}
    assert sum(a == "" and b == "" for a, b in follow) == 7 and sum(a == "c" and b == "c" for a, b in follow) == 7 and ("c", "") in follow
    assert len(chain) == 40 and len(runs[5]) == 24


# 4 top-k


def brute_top(vectors, queries, k):
    out = []
    for qi, q in queries:
        scored = sorted((-sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(q, v, strict=False)), i) for i, v in vectors if i != qi)
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "equal", "ties", "few", "large", "mixed"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(5)
    n, d = {"few": (3, 8), "equal": (300, 8)}.get(kind, (400, 8))
    v = rng.normal(0, 0.3, (n, d))
    if kind == "equal":
        v[: n // 2] = v[0]
    if kind == "ties":
        v = np.round(v * 2) / 2
    if kind == "large":
        v = v * 1e6
    rows = [(i, [float(x) for x in (r if kind != "mixed" else r[: 1 + i % d])]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    assert got == brute_top(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_top_k_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, []), (6, [-1.0, 0.5]), (6, [-1.0, 0.5])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("vec_id", "v")).withColumnRenamed("v", "vec_id")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    assert got == [(0, 1, 5, 0), (0, 2, 6, -65536), (0, 3, 6, -65536)]
    assert topk.top_k(df.limit(0), df, 5).count() == 0 and topk.top_k(df, df.limit(0), 5).count() == 0


@pytest.mark.parametrize("shift", [0.0, 2.0, -2.0])
def test_top_k_in_rounds(spark, monkeypatch, shift):
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    v = np.random.default_rng(8).normal(0, 0.3, (500, 8))
    v[:, :4] += shift  # one list holds most of a score
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    assert got == brute_top(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_top_k_shuffles_no_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 8)
    v = np.random.default_rng(9).normal(0, 0.125, (4096, 64))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        them = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(them.apply(i).totalShuffleWrite() for i in range(them.size()))

    before = shuffled()
    assert topk.top_k(df, df.where("vec_id % 16 = 0"), 5).count() == 256 * 5
    assert shuffled() - before < 16 * v.size * 4


# 5 SimHash


def brute_fingerprint(text, words=3):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    root = {i: i for i in ids}
    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            ra, rb = a, b
            while root[ra] != ra:
                ra = root[ra]
            while root[rb] != rb:
                rb = root[rb]
            root[max(ra, rb)] = min(ra, rb)
    out = {}
    for i in ids:
        r = i
        while root[r] != r:
            r = root[r]
        out[i] = r
    return out


@pytest.mark.parametrize("most", [256, 4])
def test_simhash_links(spark, most):
    base = [prose(i, 200) for i in range(25)]
    texts = [*ODD[:6], *base, *[t + " tail" for t in base], *[t.replace("alpha", "ALPHA") for t in base[:10]], *["same text for a large group of copies"] * 20]
    rows = {r.id: r for r in simhash.near_duplicates(clashing(docs_of(spark, texts)), most=most).collect()}
    fp = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fp & (2**64 - 1) for i, r in rows.items()} == fp
    assert {i: r.component_id for i, r in rows.items()} == brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_dense_fingerprints_link_in_blocks(spark):
    rng = np.random.default_rng(0)
    fps = [int(x) for x in np.unique(rng.integers(0, 2**12, 300))]  # all agree in the upper bands
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for most in (16, 4):
        got = {r.node: r.root for r in components.components(simhash.links(df, most=most)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_masks_hold_every_linked_pair():
    rng = np.random.default_rng(3)
    for max_bits in (0, 1, 2, 3):
        for _ in range(50):
            a, bits = int(rng.integers(0, 2**63)), rng.choice(64, max_bits, replace=False)
            b, masks = a ^ sum(1 << int(i) for i in bits), [0]
            for _ in range(6):  # however often lists are divided, one way keeps the pair together
                masks = [m for mask in masks for m in simhash.agreeing(mask, max_bits) if a & m == b & m]
                assert masks
                masks = masks[:2]


def test_documents_are_rows_not_ids(spark):
    x, y = prose(1, 60), prose(2, 60)
    rows = docs_of(spark, [x, x, y, x, None, None], [1, 4, 4, 1, 9, 9])
    for similarity in (0.8, None):
        kept = simhash.drop_near_duplicates(clashing(rows), similarity=similarity).collect()
        assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, x), (4, y), (9, "")]
    named = spark.createDataFrame([("b" * 50, y), ("a" * 50, y), ("c", x)], "doc_id string, text string")
    assert sorted(r.doc_id[:1] for r in simhash.drop_near_duplicates(named).collect()) == ["a", "c"]


def test_long_lists_are_dealt_in_blocks_without_loss(spark):
    rng = np.random.default_rng(12)
    texts = []
    for m in range(90):  # one family: all share lists, some pairs are alike and some aren't
        at = set(rng.choice(124, int(rng.integers(0, 4)), replace=False).tolist())
        texts.append(" ".join(f"v{m}x{k}" if k in at else f"w{k}" for k in range(124)))
    sets = [set(nearcopies.shingle_set(nearcopies.normal_words(t), 5).tolist()) for t in texts]
    want = brute_components(list(range(90)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    docs = docs_of(spark, texts)
    rows = nearcopies.sketches(docs, "doc_id", "text", 5).cache()
    reps = rows.select("rep", "wide", "keys", F.struct("id", "h").alias("row"))
    lists = nearcopies.band_lists(reps)
    pairs = nearcopies.close_pairs(reps, lists, 16)
    wanted = reps.select(F.col("rep").alias("w"))
    s = nearcopies.shingle_sets(wanted, reps, docs, "doc_id", "text", 5)
    linked = nearcopies.verified(pairs, s, 0.8)
    more = nearcopies.further_pairs(reps, lists, components.components(linked), s, 0.8, 16)
    got = {r.node: r.root for r in components.few_components(components.components(linked).select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)).collect()}
    groups = {}
    for r in rows.select("id", "rep").collect():
        groups.setdefault(bytes(got.get(r.rep, r.rep)), []).append(r.id)
    assert sorted(map(sorted, groups.values())) == sorted([i for i in want if want[i] == root] for root in set(want.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=24), min_size=2, max_size=14), st.integers(0, 3))
def test_pivot_tables_lose_no_link(sets, groups):
    found = [np.array(sorted(x), dtype="<u4") for x in sets]
    parts = [i % (groups + 1) if groups else i for i in range(len(found))]
    wide = np.zeros((len(found), 4), dtype=np.uint64)
    pairs = nearcopies.joining_pairs(wide, found, parts, 0.6)
    close = lambda a, b: len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])
    assert all(close(a, b) and parts[a] != parts[b] for a, b in pairs)
    ids = list(range(len(found)))
    known = lambda a, b: parts[a] == parts[b]
    assert brute_components(ids, lambda a, b: known(a, b) or (a, b) in pairs or (b, a) in pairs) == brute_components(ids, lambda a, b: known(a, b) or close(a, b))


def test_similar_documents(spark):
    base = [prose(100 + i, 120) for i in range(12)]
    near = [" ".join("other" if k in (20, 60) else w for k, w in enumerate(t.split())) for t in base]
    far = [" ".join("else" if k % 9 == 0 else w for k, w in enumerate(t.split())) for t in base]
    texts = [*base, *near, *far, *base[:3], *ODD]
    sets = {i: set(nearcopies.shingle_set(nearcopies.normal_words(t), 5).tolist()) for i, t in enumerate(texts)}
    link = lambda a, b: (not sets[a] and not sets[b]) or bool(sets[a] | sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    want = brute_components(list(sets), link)
    got = {r.id: r.component_id for r in simhash.similar_documents(docs_of(spark, texts)).collect()}
    assert got == want and any(want[12 + i] == i for i in range(12))
    kept = simhash.drop_near_duplicates(clashing(docs_of(spark, texts)).drop("id"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    twice = docs_of(spark, ["p q r", "p q r", "p q r", "z"], [4, 4, None, None])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.drop_near_duplicates(twice).collect()) == [(False, 4), (True, 0), (True, 0)]


def test_links_between_refuted_pairs(spark):
    rng = np.random.default_rng(11)
    texts = []
    for f in range(12):
        base = [f"w{f}x{k}" for k in range(124)]
        for m in range(30):
            at = set(rng.choice(124, int(rng.integers(1, 4)), replace=False).tolist())
            texts.append(" ".join(f"v{f}x{m}x{k}" if k in at else w for k, w in enumerate(base)))
    sets = [set(nearcopies.shingle_set(nearcopies.normal_words(t), 5).tolist()) for t in texts]
    want = brute_components(list(range(len(texts))), lambda a, b: a // 30 == b // 30 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    assert {r.id: r.component_id for r in simhash.similar_documents(docs_of(spark, texts)).collect()} == want


def test_short_texts_link_at_any_distance(spark):
    rng, wide = np.random.default_rng(5), lambda t: np.frombuffer(nearcopies.wide_fingerprint(nearcopies.shingle_set(nearcopies.normal_words(t), 5)), dtype=np.uint64)
    texts = []
    while len(texts) < 12:
        w = [f"w{k}" for k in rng.integers(0, 10**6, 9)]
        if np.bitwise_count(wide(" ".join(w)) ^ wide(" ".join(w[:8]))).sum() > 60:
            texts += [" ".join(w), " ".join(w[:8])]
    got = {r.id: r.component_id for r in simhash.similar_documents(docs_of(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(12)}


def test_spanning_forest_keeps_what_is_connected():
    rng = np.random.default_rng(4)
    wide = rng.integers(0, 2**63, (40, 4), dtype=np.uint64)
    wide[20:] = wide[:20]
    wide[20:, 0] ^= np.uint64(0b1011)
    pairs = nearcopies.spanning_forest(wide, 60)
    assert sorted(tuple(sorted(p)) for p in pairs) == [(i, i + 20) for i in range(20)]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)}


def test_components_dont_end_unfinished(spark):
    with pytest.raises(RuntimeError, match="converged"):
        components.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), most_rounds=1)


@pytest.mark.parametrize("kind, at", [("bigint", int), ("binary", lambda i: b"%02d" % i), ("string", str)])
def test_few_components_take_no_python_worker(spark, kind, at):
    edges = spark.createDataFrame([(at(i), at(i + 1)) for i in range(10, 20)] + [(at(40), at(30))], f"a {kind}, b {kind}")
    got = components.few_components(edges)
    assert {r.node: r.root for r in got.collect()} == {at(i): at(10) for i in range(10, 21)} | {at(30): at(30), at(40): at(30)}
    assert "PythonRDD" not in got._jdf.queryExecution().toRdd().toDebugString() and got.dtypes == [("node", kind), ("root", kind)]
    assert components.few_components(edges.limit(0)).collect() == []


# 7 SentencePiece


@pytest.fixture(scope="module")
def piece_file():
    return read_tokenizer(tokenizer_path("piece_bpe_32k.model"))


def test_pieces_are_the_best_segmentation(piece_file):
    import sentencepiece

    sp, m = sentencepiece.SentencePieceProcessor(model_proto=piece_file), pieces.PieceModel(piece_file)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    for text in ["the quick brown fox", "don't stop", "a  b   c ", "xyzzyqq", "Ünïcode 漢字 🙂", "\n\nline", prose(1, 12)]:
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-1e30] * len(marked)
        for end in range(1, len(marked) + 1):
            for a in range(max(0, end - 50), end):
                best[end] = max(best[end], best[a] + score.get(marked[a:end], m.unknown_score if end - a == 1 else -1e30))
        ids = np.frombuffer(m.encode(text), dtype="<u4").tolist()
        total, run = 0.0, b""
        for i in ids:
            if sp.is_byte(i):
                run += m.bytes_of[i]
                continue
            total += score[sp.id_to_piece(i)]
        assert total + m.unknown_score * len(run.decode()) == pytest.approx(best[-1], abs=1e-3), text
        assert sp.decode(ids) == text


def unigram_file(pieces):
    """A model file by hand: pieces with scores, unigram, nothing normalised; fields as protocol buffers write them."""
    import struct

    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    field = lambda no, data: varint(no << 3 | 2) + varint(len(data)) + data
    out = b""
    for i, (text, score) in enumerate([("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), *pieces]):
        out += field(1, field(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(2 if i == 0 else 3 if i < 3 else 1))
    trainer = varint(3 << 3) + varint(1)
    normalizer = field(1, b"identity") + b"".join(varint(k << 3) + varint(v) for k, v in ((3, 1), (4, 0), (5, 1)))
    return out + field(2, trainer) + field(3, normalizer)


def test_unigram_ids_are_the_library_s():
    import sentencepiece

    rng = np.random.default_rng(6)
    names = sorted({"▁" * int(rng.integers(0, 2)) + "".join(rng.choice(list("abcde"), int(rng.integers(1, 5)))) for _ in range(160)} | {"▁", *"abcd"})  # e isn't a piece for certain
    raw = unigram_file([(x, float(np.float32(-rng.uniform(1, 12)))) for x in names if x != "e"])
    sp, m = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.PieceModel(raw)
    for _ in range(400):
        text = "".join(rng.choice(list("abcdef    "), int(rng.integers(1, 40))))
        want, got, run = sp.encode(text), [], False
        for i in np.frombuffer(m.encode(text), dtype="<u4").tolist():  # the library joins neighbours that are unknown
            if not (i == sp.unk_id() and run):
                got.append(i)
            run = i == sp.unk_id()
        assert got == want, (text, sp.encode(text, out_type=str))


def test_carried_columns_give_way(spark, piece_file):
    docs = docs_of(spark, ["a b", None]).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(3))
    got = pieces.decoded(pieces.encoded(docs, piece_file, carry=("ids", "decoded", "lang")), piece_file)
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "lang"] and {r.doc_id: r.decoded for r in got.collect()} == {0: "a b", 1: ""}


def test_pieces_round_trip(spark, piece_file):
    texts = [*ODD, "▁ a mark ▁▁", " lead", "  two", "trail  ", "\n \n", pieces.OWN_MARK, "a\x00b", prose(2, 3000)]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in pieces.digests(pieces.decoded(pieces.encoded(docs, piece_file, carry=("lang",)), piece_file)).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded == (t or "") and got[i].n_tokens == len(got[i].ids) // 4 and got[i].ids_crc32 == zlib.crc32(got[i].ids) and got[i].lang == "en"
    assert pieces.encoded(docs_of(spark, []), piece_file).count() == 0


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text_comes_back(text):
    m = pieces.loaded(read_tokenizer(tokenizer_path("piece_bpe_32k.model")))
    assert m.decode(m.encode(text)) == text


# 8 toxicity


def distance(a, b):
    """Edits, a swap of neighbours being one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_automaton_is_edit_distance():
    rng = np.random.default_rng(7)
    terms = ["stupid", "idiot", "trash", "fool", "stupor"]
    auto = toxicity.LexiconAutomaton({t: (1.0, False) for t in terms})
    words = [*terms, *("".join(rng.choice(list("stupidofrah"), rng.integers(1, 9))) for _ in range(400))]
    for t in terms:
        words += [t[:i] + t[i + 1 :] for i in range(len(t))] + [t[:i] + "x" + t[i:] for i in range(len(t) + 1)] + [t[:i] + "x" + t[i + 1 :] for i in range(len(t))]
        words += [t[:i] + t[i + 1] + t[i] + t[i + 2 :] for i in range(len(t) - 1)]
    for w in words:
        best = min((distance(w, t), t) for t in terms if distance(w, t) <= (1 if len(t) >= 5 else 0)) if any(distance(w, t) <= (1 if len(t) >= 5 else 0) for t in terms) else None
        got = auto.match(w)
        assert (got is None) == (best is None) and (got is None or got[1] == best[0]), w
    stem = toxicity.LexiconAutomaton({"idio": (1.0, True)})
    assert stem.match("idiotic") == ("idio", 0) and stem.match("xidiot") is None


def test_toxicity_learns_and_tells_quotation_from_abuse(spark):
    pos = [prose(i, 20) + f" you are a filthyword{'' if i % 2 else 's'} " + prose(i + 500, 10) for i in range(60)]
    neg = [prose(i + 1000, 40) for i in range(60)]
    docs = docs_of(spark, pos + neg)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    s = model.score(["you filthyword", "you filthywrod x", "you fillthyword", "you flithyword", 'he said "filthyword" and left', prose(1, 30), None, ""]).score.tolist()
    assert min(s[:4]) > 0.3 and s[4] < s[0] and max(s[5:]) < 0.3
    kept = toxicity.reject_toxic(clashing(docs), model)
    assert {r.doc_id for r in kept.collect()} == set(range(60, 120)) and kept.columns == clashing(docs).columns
    same = toxicity.fit([(t, int(i < 60)) for i, t in enumerate(pos + neg) if zlib.crc32(str(i).encode()) % 4 != 2])
    assert same.terms == model.terms and same.plain == model.plain and same.weights == pytest.approx(model.weights)
    again = docs.unionAll(docs).unionAll(docs_of(spark, ["word " * 60_000 + pos[0], None], [0, 7]))  # repeated rows, a very long text, a null
    assert toxicity.train(again, labels.unionAll(labels)).terms.keys() == model.terms.keys()
    assert model.score(["word " * 60_000 + "you filthyword"]).hits.tolist() == model.score(["you filthyword"]).hits.tolist()
    empty = toxicity.train(docs, labels.limit(0))
    assert max(empty.score(pos[:3]).score) < 0.3 and toxicity.reject_toxic(docs_of(spark, []), model).count() == 0


def test_toxicity_takes_one_python_worker_a_task(spark, monkeypatch):
    docs = docs_of(spark, [prose(i, 20) + " filthyword" * (i < 60) for i in range(120)])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, toxic int")
    frame, plans = type(docs), []
    monkeypatch.setattr(frame, "collect", lambda self, f=frame.collect: plans.append(self._jdf.queryExecution().executedPlan().toString()) or f(self))
    assert toxicity.train(docs, labels).terms
    # counts of words, of words that match by errors only, lists of positives and features, each made once
    assert [n for p in plans if (n := p.count("ArrowEvalPython"))] == [1, 1, 1, 1]


def test_learned_stems_leave_their_words_their_edits():
    docs = [(prose(i, 20) + (" what an idiot" if i % 2 else " such a loser and losers"), 1) for i in range(60)] + [(prose(i + 1000, 40), 0) for i in range(60)]
    model = toxicity.fit(docs)
    assert any(stem and "idiot".startswith(t.rstrip("*")) for t, (_, stem) in model.terms.items())
    errors = {w[:i] + x + w[j:] for w in ("idiot", "loser") for i in range(len(w) + 1) for x, j in (("", i + 1), ("q", i), ("q", i + 1)) if j <= len(w)}
    assert set(model.look(errors)) == errors and set(model.look({"idiotic", "idiot", "losers"})) == {"idiotic", "idiot", "losers"}
    for w in sorted(errors):
        assert model.score([f"{prose(5000, 4)} {w} {prose(5001, 4)}"]).hits.tolist() == [1], w
    docs = [(t + (" closer" if i % 4 == 0 and not y else ""), y) for i, (t, y) in enumerate(docs)]
    assert set(toxicity.fit(docs).look({"closer", "looser"})) == {"looser"}  # a word of its own is no misspelling


# 9 line dedup


def brute_lines(texts, edit_chars=linededup.EDIT_CHARS):
    """What stays of each text; lines are held against all earlier ones, those within one edit being found by their variants."""
    whole, variants, out = set(), {}, []
    for t in texts:
        kept = []
        for raw in (t or "").split("\n"):
            line = raw.strip(linededup.BLANKS)
            if not line:
                kept.append(raw)
                continue
            gone = line in whole
            if not gone and len(line) >= edit_chars:
                own = {line, *(line[:i] + line[i + 1 :] for i in range(len(line)))}
                gone = any(abs(len(line) - len(x)) <= 1 and distance(line, x) <= 1 and not swapped(line, x) for v in own for x in variants.get(v, ()))
            if not gone:
                kept.append(raw)
            if line not in whole and len(line) >= edit_chars:  # a removed line counts as an earlier one as well
                for v in {line, *(line[:i] + line[i + 1 :] for i in range(len(line)))}:
                    variants.setdefault(v, []).append(line)
            whole.add(line)
        out.append("\n".join(kept) if t is not None else None)
    return out


def swapped(a, b):
    """Two neighbours stand the other way round: one edit to the automaton, two here."""
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 2


def test_line_dedup(spark):
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abc de漢🙂"), 24)) for _ in range(12)]
    lines = list(base)
    for b in base:
        at = int(rng.integers(1, len(b) - 1))
        lines += [b[:at] + b[at + 1 :], b[:at] + "z" + b[at:], b[:at] + "z" + b[at + 1 :], b, "  " + b + " ", b[:at] + "zz" + b[at:]]
    rng.shuffle(lines)
    texts = [None, "", "\n\n", "short\nshort", "shorT\n short\nx", "x\ny", *["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)]]
    docs = clashing(docs_of(spark, texts))
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    want = brute_lines(texts)
    assert {i: r.text for i, r in got.items()} == dict(enumerate(want))
    for i, t in enumerate(texts):
        assert got[i]["__lf_removed"] == (len(t.split("\n")) - len(want[i].split("\n")) if t and want[i] else got[i]["__lf_removed"])
    assert linededup.dedup_lines(docs_of(spark, [])).count() == 0
    exact = {r.doc_id: r.text for r in linededup.dedup_lines(docs_of(spark, ["a line that repeats here", "a line that repeats here\na line that repeats herE"]), max_edits=0).collect()}
    assert exact[0] == "a line that repeats here" and exact[1] == "a line that repeats herE"


def test_line_dedup_ids(spark):
    t = "the very same line of text"
    rows = {(r.doc_id, r["__lf_removed"]) for r in linededup.dedup_lines(docs_of(spark, [t, t, t, t], [None, 3, 3, 9])).collect()}
    assert rows == {(None, 0), (3, 1), (9, 1)}


# 10 language


def test_language(spark):
    say = {"en": "the and of that with have this will your from they know want been good much some time".split(), "de": "und der die das nicht mit sich auf für ist den von eine auch wird sind noch nach".split()}
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(say[k], 80)), k) for i, k in enumerate(["en", "de"] * 60)]
    docs = spark.createDataFrame([(i, t, k, "s", len(t)) for i, t, k in rows] + [(500, None, "en", "s", 0), (501, "123 !?", None, "s", 5)], DOCS)
    model = language.train(docs)
    got = {r.doc_id: r.r for r in docs.select("doc_id", language.identified(F.col("text"), model).alias("r")).collect()}
    assert all(got[i].lang_pred == k and got[i].accepted for i, _, k in rows)
    assert (got[500].lang_pred, got[500].score, got[501].lang_pred) == ("und", 0.0, "und")
    assert {r.doc_id for r in language.reject_unknown(clashing(docs), model).collect()} == set(range(120))
    mixed = model.classify(rows[0][1] + " " + rows[1][1])
    assert mixed[3] < got[0].margin
    none = language.train(docs.limit(0))
    assert none.classify("the and of") == ("und", 0.0, False, 0.0)


class NaiveMatcher:
    """The lexicon by edit distance alone, a term at a time."""

    def __init__(self, terms):
        self.terms = [(t.rstrip("*") if stem else t, stem) for t, (_, stem) in terms.items()]
        self.known = {}

    def match(self, word):
        if word not in self.known:
            best = None
            for letters, stem in self.terms:
                allowed, n = 1 if len(letters) >= (8 if stem else 5) else 0, len(letters)
                heads = {word[:k] for k in range(n - 1, n + 2)} if stem else {word} if abs(len(word) - n) <= 1 else set()
                for head in heads:
                    e = 0 if head == letters else distance(head, letters) if allowed else 9
                    if e <= allowed and (best is None or e < best):
                        best = e
            self.known[word] = best
        return self.known[word]


def brute_hits(model, text, matcher):
    found = [matcher.match(m.group()) for m in toxicity.WORD.finditer((text or "").lower())]
    words = [m.group() for m in toxicity.WORD.finditer((text or "").lower())]
    found = [None if e and w in model.plain else e for w, e in zip(words, found, strict=True)]
    return sum(e is not None for e in found), sum(bool(e) for e in found)


def brute_language(model, text):
    """Names, the best first, by compressing all chunks with fresh dictionaries."""
    import zstandard

    if text is None or not any(c.isalpha() for c in text):
        return None
    data, sizes = language.letters(text), {}
    for name, d in model.dictionaries.items():
        params = zstandard.ZstdCompressionParameters.from_level(model.level, write_content_size=False, write_checksum=False, write_dict_id=False)
        made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=model.level)
        c = zstandard.ZstdCompressor(dict_data=made, compression_params=params)
        sizes[name] = max(1, sum(len(c.compress(data[i : i + model.chunk])) - 9 for i in range(0, len(data), model.chunk)))
    order = sorted(sizes, key=lambda k: (sizes[k], k))
    return order[0], len(order) < 2 or (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]] >= model.min_margin


# contracts of the queries and the pipeline

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_pipeline_stages_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        after = {r.doc_id: r for r in out.collect()}
        assert after.keys() <= before.keys() and len(after) == out.count()
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
            matcher, scored = NaiveMatcher(model.terms), model.score([r.text for r in before.values()])
            for (i, r), got in zip(before.items(), scored.itertuples(), strict=True):
                assert (got.hits, got.fuzzy_hits) == brute_hits(model, r.text, matcher) and (i in after) == (got.score < 0.3)
        if name == "language":
            model = language.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
            want = {i: brute_language(model, r.text) for i, r in before.items()}
            assert set(after) == {i for i, x in want.items() if x and x[1]} and all(x is None or model.classify(before[i].text)[0] == x[0] for i, x in want.items())
        if name == "line_dedup":
            order = sorted(before)
            want = dict(zip(order, brute_lines([before[i].text for i in order]), strict=True))
            assert {i: after[i].text for i in order} == want
        if name == "simhash":
            sets = {i: set(nearcopies.shingle_set(nearcopies.normal_words(r.text), 5).tolist()) for i, r in before.items()}
            link = lambda a, b: (not sets[a] and not sets[b]) or bool(sets[a] | sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9  # noqa: E731, B023
            assert set(after) == set(brute_components(sorted(sets), link).values())
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    rows = pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    for i, pieces in itertools.groupby(sorted(rows, key=lambda r: (r.doc_id, r.start)), key=lambda r: r.doc_id):
        pieces = list(pieces)
        assert sum(p.length for p in pieces) == pieces[0].doc_tokens, i
    whole = pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.doc_tokens) for r in whole} == {(r.doc_id, r.doc_tokens) for r in rows} and sum(r.length for r in whole) == sum(r.length for r in rows)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op3_merkle", "op4_topk", "op9_line_dedup"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from lumenframe.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, cur = QUERIES[name](spark, SMALL), con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(cur.fetchall())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_every_operator_has_a_query_over_all_rows(spark):
    from lumenframe.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op1_quality", "op2_sstable", "op3_merkle", "op5_simhash", "op7_pieces", "op8_toxicity", "op9_line_dedup", "op10_language"):
        assert QUERIES[name](spark, SMALL).count() == n, name
