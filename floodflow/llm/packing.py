"""Best-fit packing by length patterns.

Only the histogram of piece lengths (at most ``seq_len`` numbers) reaches the
driver. There, patterns of two and three lengths that fill a sequence exactly
are enumerated, their repeat counts are fitted to the histogram by non-negative
least squares on an active set, rounded, and what remains is packed best
fit, longest first, on counts of equal lengths. The plan says for every length
which rank goes to which sequence and offset; its size depends on ``seq_len``,
not on the number of documents, so broadcasting it is safe at any scale.

Ranks within a length come from counts per (task, length): every task numbers
its own pieces, and a running sum over tasks gives each one its base. No task
sees all pieces of a length.

Defined cases: null and empty texts consist of the end id alone; rows that
repeat are packed each; a null doc_id is carried through; an empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodflow.llm.base import materialize
from floodflow.llm.tokens import Encoder, default_tokenizer

SEQ_LEN = 1024
END_ID = 2
_PIECES = "doc_id long, piece int, start long, length long, ids binary, task int, rank long"
_ROUNDS = 8
_ACTIVE = 400  # patterns that join the active set per round


def pieces(docs: DataFrame, tokenizer: str | None = None, cut: str | None = "space_prefix",
           seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Tokens of every text with the end id, cut into pieces of ``seq_len`` of
    which the first may be shorter. ``ids`` are little-endian uint32."""
    path = tokenizer or default_tokenizer("byte_bpe_50k.json")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, enc, end = TaskContext.get().partitionId(), None, np.array([end_id], "<u4").tobytes()
        ranks = [0] * (seq_len + 1)
        for batch in it:
            enc = enc or Encoder.shared(path, cut)
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows: list[tuple] = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    size, at, k = (n - 1) % seq_len + 1, 0, 0
                    while at < n:
                        rows.append((doc, k, at, size, ids[4 * at:4 * (at + size)], task, ranks[size]))
                        ranks[size] += 1
                        at, k, size = at + size, k + 1, seq_len
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()),
                        strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids", "task", "rank"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


# --- the plan, on the driver: lengths and counts only -----------------------------

def exact_patterns(have: np.ndarray, seq_len: int) -> np.ndarray:
    """All pairs and triples a <= b <= c of lengths in use that sum to ``seq_len``;
    pairs have c = 0."""
    use = np.zeros(seq_len + 1, bool)
    use[have] = True
    a = have[have <= seq_len // 2]
    pair = a[use[seq_len - a]]
    out = [np.stack((pair, seq_len - pair, np.zeros_like(pair)), 1)]
    for x in have[have <= seq_len // 3]:
        b = have[(have >= x) & (have <= (seq_len - x) // 2)]
        c = seq_len - x - b
        b, c = b[use[c]], c[use[c]]
        out.append(np.stack((np.full_like(b, x), b, c), 1))
    return np.concatenate(out)


def fit(patterns: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squares of A x - hist, weighted by the
    square of the length (long pieces are hardest to place later), by an active
    set of the patterns with the steepest gradient and coordinate descent on it."""
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    weight = (np.arange(len(hist)) / len(hist)) ** 2
    left = hist.astype(float)
    left[0] = 0.0
    active: np.ndarray = np.empty(0, np.int64)
    for _ in range(_ROUNDS):
        slope = (weight * left)[patterns].sum(1)
        slope[active] = -np.inf
        new = np.argsort(-slope, kind="stable")[:_ACTIVE]
        active = np.concatenate((active, new[slope[new] > 0]))
        for _ in range(12):
            moved = 0.0
            for j in active.tolist():
                p = [v for v in patterns[j].tolist() if v]
                norm = sum(weight[v] * p.count(v) for v in p)
                step = max(sum(weight[v] * left[v] for v in p) / norm, -x[j])
                if step:
                    x[j] += step
                    for v in p:
                        left[v] -= step
                    moved = max(moved, abs(step))
            if moved < 0.25:
                break
    return x


def best_fit(hist: np.ndarray, seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: (lengths, repeats) of the sequences."""
    room: dict[int, list[list]] = {}
    for size in range(len(hist) - 1, 0, -1):
        count = int(hist[size])
        while count:
            fits = [k for k in room if k >= size]
            if fits:
                k = min(fits)
                held = room[k][-1]
                take = min(count, held[1])
                held[1] -= take
                if not held[1]:
                    room[k].pop()
                    if not room[k]:
                        del room[k]
                room.setdefault(k - size, []).append([held[0] + (size,), take])
                count -= take
                continue
            per = seq_len // size
            full, rest = divmod(count, per)
            for many, n in ((per, full), (rest, 1 if rest else 0)):
                if n:
                    room.setdefault(seq_len - many * size, []).append([(size,) * many, n])
            count = 0
    return [(lengths, n) for group in room.values() for lengths, n in group]


def plan(hist: np.ndarray, seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, repeats) for ``hist[length]`` pieces."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[seq_len]:
        out.append(((seq_len,), int(left[seq_len])))
        left[seq_len] = 0
    patterns = exact_patterns(np.flatnonzero(left), seq_len)
    x = fit(patterns, left)
    for j in np.lexsort((-x, -patterns.max(1, initial=0))).tolist():  # longest piece first
        if x[j] < 0.5:
            continue
        p = [v for v in patterns[j].tolist() if v]
        n = min(int(x[j] + 0.5), *(int(left[v]) // p.count(v) for v in p))
        if n:
            out.append((tuple(p), n))
            for v in p:
                left[v] -= n
    return out + best_fit(left, seq_len)


def slots(groups: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """Rows (length, first, last, many, base, offsets): ranks first..last of a
    length go ``many`` to a sequence from ``base`` on, at the listed offsets."""
    rows, base = [], 0
    used: dict[int, int] = {}
    for lengths, n in groups:
        at, places = 0, {}
        for v in lengths:
            places.setdefault(v, []).append(at)
            at += v
        for v, offsets in places.items():
            first = used.get(v, 0)
            used[v] = first + n * len(offsets)
            rows.append((v, first, used[v] - 1, len(offsets), base, offsets))
        base += n
    return rows


def pack(cut: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """``cut`` (length, task, rank and any payload; a written table, since task
    and rank must not change) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0))), "pack-counts")
    hist = np.zeros(seq_len + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # seq_len rows at most
        hist[r["length"]] = r["n"]
    rows = slots(plan(hist, seq_len))
    where = spark.createDataFrame(
        rows, "length long, first long, last long, many int, seq long, offsets array<long>")
    placed = (cut.join(counts.drop("n"), ["length", "task"])
              .withColumn("rank", F.col("rank") + F.col("base")))
    placed = placed.join(F.broadcast(where.withColumnRenamed("length", "_l")),
                         (F.col("length") == F.col("_l")) & F.col("rank").between(F.col("first"), F.col("last")))
    k = F.col("rank") - F.col("first")
    return (placed.withColumn("sequence_id", F.col("seq") + F.floor(k / F.col("many")))
            .withColumn("offset", F.element_at("offsets", (k % F.col("many") + 1).cast("int")))
            .drop("task", "rank", "base", "_l", "first", "last", "many", "seq", "offsets"))
