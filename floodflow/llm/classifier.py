"""Quality classifier: random-indexing word vectors and a small network.

Every token has a fixed sparse random index vector. One pass over all documents
adds the index vectors of its neighbours to each token's context vector; tokens
are hashed to ``TOKENS`` rows, so the table has a fixed size and can be summed in
slices and broadcast at any scale. A second pass pools the vectors of a
document's tokens (mean and spread). A two-layer network is trained on a
bounded sample of labelled documents, its probabilities are calibrated by one
temperature on rows held back for that, and it scores every document.

Tokens are runs of letters (lower-cased), of digits or of marks, with extra
tokens for upper-case words and for words that repeat the one before.

Defined cases: null and empty texts have no tokens, an all-zero pooling, and
are scored like any other; labels that are null or of unknown documents teach
nothing, a document with several labels counts with its smallest; without both
classes among the labels every score is the share of label 1 (0.5 without
labels); rows that repeat get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodflow.llm.base import materialize
from floodflow.llm.blocks import Block, batches, mix

TOKENS = 1 << 14
DIMS = 48
NONZERO = 4
SLICES = 64
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.7
_UPPER, _REPEAT = TOKENS - 1, TOKENS - 2
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every token's index vector."""
    h = mix(np.arange(TOKENS * NONZERO, dtype=np.uint64) + np.uint64(0xA5A5))
    return ((h % np.uint64(DIMS)).astype(np.int64).reshape(TOKENS, NONZERO),
            np.where(h >> np.uint64(63), 1, -1).astype(np.int64).reshape(TOKENS, NONZERO))


def token_rows(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of texts: index range, token rows and the text of each token."""
    for a, b in batches(texts):
        raw = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        block = Block([t.translate(_LOWER) for t in texts[a:b]])
        kind = _KIND[raw]
        n = len(raw)
        cut = np.zeros(n + 1, bool)
        cut[:1] = True
        cut[1:n] = kind[1:] != kind[:-1]
        cut[block.starts[block.starts < n]] = True
        start = np.flatnonzero(cut[:n])
        end = np.r_[start[1:], n].astype(np.int64)
        real = kind[start] > 0 if n else np.empty(0, bool)
        start, end = start[real], end[real]
        text = np.searchsorted(block.ends, start, side="right")
        h = block.range_hash(start, end)
        # runs of marks count by their first mark and whether there are more
        marks = kind[start] == 3
        h[marks] = mix(raw[start[marks]].astype(np.uint64) * np.uint64(2) + (end - start > 1)[marks])
        rows = (h % np.uint64(TOKENS - 2)).astype(np.int64)
        loud = (end - start > 1) & (raw[start] >= 65) & (raw[start] <= 90)
        loud[loud] = (raw[start[loud] + 1] >= 65) & (raw[start[loud] + 1] <= 90)
        letters = np.flatnonzero(kind[start] == 1)
        again = np.zeros(len(rows), bool)
        if len(letters):
            again[letters[1:]] = (h[letters[1:]] == h[letters[:-1]]) & (text[letters[1:]] == text[letters[:-1]])
        place = np.concatenate((np.arange(len(rows)), np.flatnonzero(loud) + 0.3, np.flatnonzero(again) + 0.6))
        value = np.concatenate((rows, np.full(loud.sum(), _UPPER), np.full(again.sum(), _REPEAT)))
        o = np.argsort(place, kind="stable")
        yield a, b, value[o], text[place[o].astype(np.int64)] if len(text) else text


def _bytes() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")


def _contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    table = np.zeros(TOKENS * DIMS)
    for batch in it:
        for _, _, rows, text in token_rows(batch.column("text").to_pylist()):
            side = np.flatnonzero(text[1:] == text[:-1]) if len(text) > 1 else np.empty(0, np.int64)
            x, y = rows[side], rows[side + 1]
            for i, j in ((x, y), (y, x)):
                for k in range(NONZERO):
                    table += np.bincount(i * DIMS + place[j, k], sign[j, k], TOKENS * DIMS)
    per = TOKENS * DIMS // SLICES
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(SLICES), pa.int32()),
         pa.array([table[i * per:(i + 1) * per].astype("<i8").tobytes() for i in range(SLICES)], pa.binary())],
        names=["part", "sums"])


def _add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in it:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            got = np.frombuffer(raw, "<i8")
            sums[part] = sums[part] + got if part in sums else got
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
        names=["part", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """TOKENS x DIMS vectors: own index vector plus the direction of all contexts."""
    kind = "part int, sums binary"
    rows = (docs.select(_bytes()).mapInArrow(_contexts, kind).repartition(F.col("part"))
            .mapInArrow(_add, kind).toArrow())  # TOKENS * DIMS numbers, whatever the input
    table = np.zeros((SLICES, TOKENS * DIMS // SLICES))
    for part, raw in zip(rows.column("part").to_pylist(), rows.column("sums").to_pylist(), strict=True):
        table[part] = np.frombuffer(raw, "<i8")
    table = table.reshape(TOKENS, DIMS)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1.0)
    place, sign = index_vectors()
    np.add.at(table, (np.repeat(np.arange(TOKENS), NONZERO), place.ravel()), sign.ravel() / 2.0)
    return table.astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and ``x``: mean and spread of the token vectors, and the log count."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in it:
            out = np.zeros((batch.num_rows, 2 * DIMS + 1), np.float32)
            for a, b, rows, text in token_rows(batch.column("text").to_pylist()):
                at = np.searchsorted(text, np.arange(b - a + 1))
                for i in range(b - a):
                    n = at[i + 1] - at[i]
                    if n:
                        v = table[rows[at[i]:at[i + 1]]]
                        out[a + i, :DIMS] = v.mean(0)
                        out[a + i, DIMS:-1] = v.std(0)
                        out[a + i, -1] = np.log1p(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r.tobytes() for r in out], pa.binary())], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _bytes()).mapInArrow(run, "doc_id long, x binary")


@dataclass
class Network:
    """tanh layer, then one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 128,
          rate: float = 0.005, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on cross entropy; every fifth row only sets the temperature."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    flat = Network(mean, scale, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log(base / (1 - base))))
    held = np.arange(len(x)) % 5 == 4
    if len(np.unique(y[~held])) < 2:
        return flat
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z, target = ((x - mean) / scale)[~held], y[~held]
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), batch):
            i = order[at:at + batch]
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - target[i]) / len(i)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[i].T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
            t += 1
            for a, g, m1, v1 in zip(p, grads, m, v, strict=True):
                m1 += 0.1 * (g - m1)
                v1 += 0.001 * (g * g - v1)
                a -= rate * (m1 / (1 - 0.9 ** t)) / (np.sqrt(v1 / (1 - 0.999 ** t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if held.any():
        logit = net.logits(x[held])

        def loss(temp: float) -> float:
            s = logit / temp
            return float(np.mean(np.logaddexp(0, s) - y[held] * s))

        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        net.temperature = float(min(grid, key=loss))
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality",
                  max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    rows = materialize(pooled(docs, word_vectors(docs)), "quality-pooled")
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min(label).alias("y")).where(~held_out()))
    sample = (rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "x")
              .limit(max_train_rows).select("x", "y").toArrow())
    size = 2 * DIMS + 1
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float32).reshape(-1, size)
    net = train(x, np.array(sample.column("y").to_pylist(), np.float64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            z = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(net.score(z), pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
