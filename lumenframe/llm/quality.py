"""Quality: a byte-level convolutional network in numpy.

Learned filters run over every byte of a document; the bytes are cut into
overlapping chunks that cover the whole text, each filter is max-pooled within
a chunk, and the mean, largest and smallest pooled value over the chunks go
through one logistic unit.  As the input is one-hot bytes, a filter is a table
look-up; two neighbouring bytes share one table when scoring.

Defined cases: a null or empty text is one chunk of zero bytes; texts of any
length are read whole; other columns pass by; repeated rows score alike; an empty table gives an empty result; without training rows of
both classes the score is the share of the class there is (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import logistic, sampled_labels, sigmoid, tidy

WIDTH, FILTERS, BLOCK = 6, 16, 128  # a chunk is two blocks, so chunks overlap by half
#: Documents of either class that the fit takes; they are cut into pieces of so many chunks, of which it reads so many.
TRAIN_DOCS, PIECE_CHUNKS, TRAIN_PIECES = 1_200, 24, 6_000
EPOCHS, BATCH, RATE = 6, 48, 0.02


def chunk_windows(data: bytes) -> np.ndarray:
    """All overlapping chunks of a text, one row each, with the bytes that the last filters reach."""
    size = 2 * BLOCK + WIDTH - 1
    n = max(1, -(-(max(len(data) - WIDTH + 1, 1) - BLOCK) // BLOCK)) if len(data) > BLOCK else 1
    padded = np.zeros((n - 1) * BLOCK + size, dtype=np.uint8)
    got = np.frombuffer(data[: len(padded)], dtype=np.uint8)
    padded[: len(got)] = got
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::BLOCK]


def with_size(z: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Adds how much of a chunk a short text leaves empty, alone and times the mean pooled values.

    Fewer positions give lower maxima, which says nothing about quality.
    """
    short = np.maximum(0, 1 - sizes / (2 * BLOCK))[:, None]
    return np.hstack([z, short, short * z[:, :FILTERS]])


@dataclass
class QualityModel:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    head: np.ndarray  # (4 * FILTERS + 1,)
    intercept: float
    _pairs: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def pooled(self, data: bytes) -> np.ndarray:
        """Pooled activations of every chunk: (chunks, FILTERS)."""
        if self._pairs is None:
            t = self.table.astype(np.float32)
            self._pairs = np.stack([(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)])
        if len(data) < WIDTH:
            data = data + bytes(WIDTH - len(data))
        b = np.frombuffer(data, dtype=np.uint8)
        pair = b[:-1].astype(np.uint16) << 8 | b[1:]
        n = len(b) - WIDTH + 1
        blocks = []
        step = 256 * BLOCK
        for at in range(0, n, step):
            m = min(step, n - at)
            out = self._pairs[0].take(pair[at : at + m], axis=0)
            for j in range(1, WIDTH // 2):
                out += self._pairs[j].take(pair[at + 2 * j : at + 2 * j + m], axis=0)
            full = m // BLOCK
            if full:
                blocks.append(out[: full * BLOCK].reshape(full, BLOCK, -1).max(axis=1))
            if m % BLOCK:
                blocks.append(out[full * BLOCK :].max(axis=0, keepdims=True))
        x = np.concatenate(blocks)
        if len(x) > 1:
            x = np.maximum(x[:-1], x[1:])
        return np.tanh(x + self.bias.astype(np.float32))

    def features(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "replace")
        a = self.pooled(data)
        return with_size(np.concatenate([a.mean(axis=0), a.max(axis=0), a.min(axis=0)])[None], np.array([len(data)]))[0]

    def score(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return sigmoid(np.array([self.features(t) for t in texts], dtype=np.float64) @ self.head + self.intercept)


def fit(chunks: list[np.ndarray], y: np.ndarray, seed: int = 7, share: np.ndarray | None = None) -> QualityModel:
    """Adam on the filters with the gradient of max-pooling; the head is then refitted.

    ``share``: what each row counts, 1 unless it is a piece of a document.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.25, (WIDTH, 256, FILTERS))
    bias = np.full(FILTERS, -0.6)
    head = rng.normal(0, 0.3, 3 * FILTERS)
    c = np.zeros(1)
    y = np.asarray(y, dtype=float)
    share = np.ones(len(y)) if share is None else share
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else (0.98 if y[0] else 0.02)
        return QualityModel(table, bias, np.zeros(4 * FILTERS + 1), float(np.log(p / (1 - p))))
    # short texts are rare among the labelled ones: half of the documents lend a short piece as well
    more = []
    for i in np.flatnonzero(rng.random(len(y)) < 0.5):
        row, n = chunks[i][rng.integers(len(chunks[i]))], int(rng.integers(12, 120))
        row = row[row != 0]
        at = int(rng.integers(max(1, len(row) - n)))
        short = np.zeros((1, 2 * BLOCK + WIDTH - 1), dtype=np.uint8)
        short[0, : len(row[at : at + n])] = row[at : at + n]
        more.append((short, y[i], share[i]))
    chunks, y, share = chunks + [x for x, _, _ in more], np.concatenate([y, [v for _, v, _ in more]]), np.concatenate([share, [v for _, _, v in more]])
    params = [table, bias, head, c]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    mean_label = (share * y).sum() / share.sum()
    class_weight = share / share.mean() * np.where(y == 1, 0.5 / mean_label, 0.5 / (1 - mean_label))
    size, t = 2 * BLOCK, 0

    def forward(rows: np.ndarray):
        f32 = table.astype(np.float32)
        out = f32[0][rows[:, :size]]
        for j in range(1, WIDTH):
            out += f32[j][rows[:, j : j + size]]
        filled = rows.shape[1] - (rows[:, ::-1] != 0).argmax(axis=1)
        filled[~rows.any(axis=1)] = 0
        for i in np.flatnonzero(filled < rows.shape[1]):  # the end of a text: no filter looks past it
            out[i, max(1, filled[i] - WIDTH + 1) :] = -1e9
        at = out.argmax(axis=1)
        return at, np.tanh(np.take_along_axis(out, at[:, None, :], axis=1)[:, 0] + bias)

    def gather(a: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        return np.add.reduceat(a, starts) / sizes[:, None], np.maximum.reduceat(a, starts), np.minimum.reduceat(a, starts)

    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            rows = np.concatenate([chunks[i] for i in own])
            sizes = np.array([len(chunks[i]) for i in own])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at, a = forward(rows)
            mean, most, least = gather(a, starts, sizes)
            z = np.hstack([mean, most, least])
            d = class_weight[own] * (sigmoid(z @ head + c[0]) - y[own]) / len(own)
            gz = d[:, None] * head
            doc = np.repeat(np.arange(len(own)), sizes)
            ga = gz[doc, :FILTERS] / sizes[doc][:, None] + gz[doc, FILTERS : 2 * FILTERS] * (a == most[doc]) + gz[doc, 2 * FILTERS :] * (a == least[doc])
            ga = ga * (1 - a * a)
            gt = np.zeros_like(table)
            r = np.arange(len(rows))[:, None]
            for j in range(WIDTH):
                np.add.at(gt[j], (rows[r, at + j], np.arange(FILTERS)[None, :]), ga)
            grads = [gt, ga.sum(axis=0), z.T @ d + 1e-3 * head, np.array([d.sum()])]
            t += 1
            for p, g, u, v in zip(params, grads, m1, m2, strict=True):
                u *= 0.9
                u += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= RATE * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    reps = []
    for k in range(0, len(y), 256):
        part = chunks[k : k + 256]
        sizes = np.array([len(x) for x in part])
        _, a = forward(np.concatenate(part))
        z = np.hstack(gather(a, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes))
        reps.append(with_size(z, np.array([(x != 0).sum() if len(x) == 1 else 4 * BLOCK for x in part])))
    w, b = logistic(np.concatenate(reps), y, l2=3e-4, share=share)
    return QualityModel(table, bias, w, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS) -> QualityModel:
    """Fits on at most ``train_docs`` labelled documents of each class outside the held-out fold.

    The executors cut the whole texts into pieces.  At most TRAIN_PIECES pieces,
    chosen by a hash of id and place from any part of any of these texts, come
    to the driver; each counts as its share of the document.
    """
    ids = sampled_labels(labels, id_col, label, train_docs)
    size = 2 * BLOCK + WIDTH - 1

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ident, value, text in zip(pdf["id"], pdf["label"], pdf["text"], strict=True):
                rows = chunk_windows((text if isinstance(text, str) else "").encode("utf-8", "replace"))
                n = -(-len(rows) // PIECE_CHUNKS)
                for a in range(0, n, 256):  # some pieces at a time
                    nos = range(a, min(n, a + 256))
                    parts = [np.ascontiguousarray(rows[k * PIECE_CHUNKS : (k + 1) * PIECE_CHUNKS]).tobytes() for k in nos]
                    yield pd.DataFrame({"id": [ident] * len(nos), "label": [value] * len(nos), "no": list(nos), "n": [n] * len(nos), "chunks": parts})

    chosen = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
        .groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("id", "label", "text")
    )
    id_type = chosen.schema["id"].dataType.simpleString()
    pieces = chosen.mapInPandas(cut, f"id {id_type}, label int, no int, n int, chunks binary")
    # places first, so that the sort holds no bytes; a place is cut again where it was chosen
    few = pieces.select("id", "no").orderBy(F.xxhash64("id", "no"), "id", "no").limit(TRAIN_PIECES)
    got = sorted((r.id, r.no, r.label, r.n, bytes(r.chunks)) for r in pieces.join(F.broadcast(few), ["id", "no"]).collect())
    return fit([np.frombuffer(x[4], dtype=np.uint8).reshape(-1, size) for x in got], np.array([x[2] for x in got]), share=np.array([1 / x[3] for x in got]))


def scored(text: Column, model: QualityModel) -> Column:
    """Probability column for a text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(lambda rest: (pd.Series(model.score([None if v is None or v != v else v for v in s])) for s in rest))(batches)

    return score(text)
