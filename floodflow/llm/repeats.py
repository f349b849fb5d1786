"""Repeated byte strings by an enhanced suffix array over anchored suffixes.

Two equal strings of ``MIN_BYTES`` bytes contain the same anchors: positions
whose ``GRAM``-byte hash is the smallest in a window of
``MIN_BYTES - GRAM + 1`` positions (winnowing, leftmost on ties). So only
anchored suffixes are sorted, about one in forty positions.

1. Every map task hashes its texts, takes the anchors, and keeps for each
   (gram, context) only the first occurrence it saw, where the context is all
   bytes that strings of ``MIN_BYTES`` over the anchor can reach. Later
   occurrences are wholly repeated; they leave the task as merged spans. This
   bounds what any hot string sends to ``tasks`` rows.
2. One shuffle by gram finds the later occurrences across tasks and the grams
   that have several different contexts.
3. For those, the contexts' bytes are fetched and each gram's suffixes are
   sorted; the longest-common-prefix array is scanned with a stack into the
   tree of common-prefix intervals. In each interval the members are split by
   their left extensions: members that agree on ``MIN_BYTES`` bytes in all form
   a maximal repeat, its first occurrence stays, and the others yield spans.
4. Spans are merged per document and cut out of the bytes.

Equality of contexts in steps 1 and 2 is taken from
40-bit gram and 64-bit context hashes together; step 3 compares bytes.

Defined cases: a null text is empty; texts shorter than ``MIN_BYTES`` keep all
bytes; a null doc_id sorts before all others; rows that repeat id and text are
one document and get equal rows; rows that share only the id are told apart
and ordered by a 64-bit hash of id and text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodflow.llm.base import materialize, row_key
from floodflow.llm.blocks import Block, batches, mix

MIN_BYTES = 100
GRAM = 24
REACH = MIN_BYTES - GRAM  # bytes a string can have before its anchor
#: Text whose anchors are sorted and emitted at once.
EMIT_BYTES = 1 << 23
HOT = 2000  # contexts of one gram that are dealt out further
_NO_ID = -(1 << 63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the block's anchors and the index of each one's text."""
    width = MIN_BYTES - GRAM + 1
    none = np.empty(0, np.int64)
    if not (block.ends - block.starts >= MIN_BYTES).any():
        return none, none
    grams = block.gram_hash(GRAM)
    if len(grams) < width:
        return none, none
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(keys, width)
    inside = np.zeros(len(least) + 1, np.int8)  # windows that lie in one text
    long = block.ends - block.starts >= MIN_BYTES
    np.add.at(inside, block.starts[long], 1)
    np.add.at(inside, block.ends[long] - MIN_BYTES + 1, -1)
    least = least[np.cumsum(inside[:-1]) > 0] & np.uint64(0xFFFFFFFF)
    pos = least[np.r_[True, least[1:] != least[:-1]]].astype(np.int64)
    return pos, np.searchsorted(block.ends, pos, side="right")


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of spans per document; inputs in any order."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    new = np.r_[True, doc[1:] != doc[:-1]]
    step = np.cumsum(new) - 1
    top = int(end.max()) + 1
    reach = np.maximum.accumulate(end + step * top) - step * top
    fresh = new.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return doc[at], start[at], np.maximum.reduceat(end, at)


_ROWS = pa.schema([("gram", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()),
                   ("sub", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (end 0, start is the place) and spans known to repeat."""
    for batch in it:
        texts = batch.column("text").to_pylist()
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        subs = batch.column("sub").to_numpy(zero_copy_only=False)
        for first, last in batches(texts, EMIT_BYTES):
            yield from _local_part(texts[first:last], ids[first:last], subs[first:last])
        # The worker goes on to later stages: what Arrow holds for reuse goes back.
        del texts
        pa.default_memory_pool().release_unused()


def _local_part(texts: list[bytes], ids: np.ndarray, subs: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = []
    for a, b in batches(texts):
        block = Block(texts[a:b])
        pos, text = anchors(block)
        if not len(pos):
            continue
        left = np.maximum(pos - REACH, block.starts[text])
        right = np.minimum(pos + MIN_BYTES, block.ends[text])
        gram = block.range_hash(pos, pos + GRAM) >> np.uint64(24)  # 40 bits: contexts decide
        ctx = mix(block.range_hash(left, right) ^ mix(
            ((pos - left).astype(np.uint64) << np.uint64(32)) | (right - pos).astype(np.uint64)))
        base = block.starts[text]
        parts.append((gram, ctx, ids[a + text], subs[a + text], pos - base, left - base, right - base))
    if not parts:
        return
    gram, ctx, doc, sub, pos, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
    o = np.lexsort((pos, sub, doc, ctx, gram))
    gram, ctx, doc, sub, pos, left, right = (x[o] for x in (gram, ctx, doc, sub, pos, left, right))
    same = np.r_[False, (gram[1:] == gram[:-1]) & (ctx[1:] == ctx[:-1])]
    first = np.flatnonzero(~same)[np.cumsum(~same) - 1]
    again = same & ((doc != doc[first]) | (sub != sub[first]) | (pos != pos[first]))
    yield _rows(gram[~same], ctx[~same], doc[~same], sub[~same], pos[~same], np.zeros_like(pos[~same]))
    if again.any():
        rank = np.unique(np.stack((doc[again], sub[again])), axis=1, return_inverse=True)
        who, start, end = merge_spans(rank[1].ravel(), left[again], right[again])
        doc_s, sub_s = rank[0][0][who], rank[0][1][who]
        yield _rows(mix(doc_s.astype(np.uint64) ^ start.astype(np.uint64)) | np.uint64(1 << 63), np.zeros(len(who), np.int64),
                    doc_s, sub_s, start, end)


def _rows(gram, ctx, doc, sub, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc), pa.array(sub),
         pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], schema=_ROWS)


# --- common-prefix interval tree -------------------------------------------------

def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Stack scan of an LCP array into common-prefix intervals.

    ``lcp[i]`` is between suffixes i-1 and i (``lcp[0]`` is ignored). Yields
    (length, parent's length, first, last) of each interval of two or more.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, max(now, stack[-1][0] if stack else -1), first, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeat_groups(suffixes: list[tuple[bytes, bytes]], min_bytes: int = MIN_BYTES
                  ) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats among anchored suffixes, each with all its occurrences.

    ``suffixes`` are (reversed left context, right context) in order of
    occurrence. Yields (left, right, members): the members agree on ``left``
    bytes before and ``right`` bytes after the anchor, ``left + right`` is at
    least ``min_bytes``, and not all members have more in common on either
    side. Members are in order of occurrence.
    """
    order = sorted(range(len(suffixes)), key=lambda i: suffixes[i][1])
    lcp = [0] + [_common(suffixes[a][1], suffixes[b][1]) for a, b in zip(order, order[1:], strict=False)]
    for right, _, first, last in intervals(lcp):
        least = max(min_bytes - right, 0)
        members = [i for i in order[first:last + 1] if len(suffixes[i][0]) >= least]
        if len(members) < 2:
            continue
        # left extensions: the same scan over the reversed left contexts
        members.sort(key=lambda i: suffixes[i][0])
        llcp = [0] + [_common(suffixes[a][0], suffixes[b][0])
                      for a, b in zip(members, members[1:], strict=False)]
        for left, _, a, b in intervals(llcp):
            if left >= least:
                group = members[a:b + 1]
                # diverse to the right within the interval, else a longer interval has it
                if right >= MIN_BYTES or _diverse(group, suffixes, right):
                    yield left, right, sorted(group)


def _diverse(group: list[int], suffixes: list[tuple[bytes, bytes]], right: int) -> bool:
    """Whether the bytes after ``right`` differ, or one has none."""
    seen = {suffixes[i][1][right:right + 1] for i in group}
    return len(seen) > 1 or b"" in seen


_CTX = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("sub", pa.int64()), ("pos", pa.int32()),
                  ("left", pa.binary()), ("right", pa.binary())])


def _contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around the wanted anchors of each text.

    A hot gram's contexts are dealt out by half: an equal string has either
    ``MIN_BYTES - REACH // 2`` bytes after the anchor's start, or more than
    ``REACH // 2`` before, so both parts together miss no pair.
    """
    half = REACH // 2
    for batch in it:
        out: list[tuple] = []
        for doc, sub, text, spots in zip(*(batch.column(c) for c in ("doc", "sub", "text", "spots")), strict=True):
            doc, sub, text, spots = doc.as_py(), sub.as_py(), text.as_py(), spots.values
            for pos, gram, many in zip(*(spots.field(c).to_numpy().tolist() for c in ("start", "gram", "many")), strict=True):
                left, right = text[max(0, pos - REACH):pos][::-1], text[pos:pos + MIN_BYTES]
                if many <= HOT:
                    out.append((gram, doc, sub, pos, left, right))
                    continue
                if len(right) >= MIN_BYTES - half:
                    out.append((_key(gram, b"r" + right[:MIN_BYTES - half]), doc, sub, pos, left, right))
                if len(left) > half:
                    out.append((_key(gram, b"l" + left[:half + 1]), doc, sub, pos, left, right))
            if len(out) >= 20_000:
                yield _ctx_batch(out)
                out = []
        if out:
            yield _ctx_batch(out)


def _ctx_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CTX, strict=True)],
                                      schema=_CTX)


def _key(gram: int, part: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(part, digest_size=8, salt=gram.to_bytes(8, "little", signed=True)
                                          ).digest(), "little", signed=True)


_SPANS = pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _group_spans(rows: list[tuple], out: list[tuple]) -> None:
    """Spans that repeat an earlier occurrence in one gram's contexts. All spans of one
    occurrence hold its anchor, so their union is one span: one row an occurrence, however
    many repeats it is part of."""
    if len(rows) < 2:
        return
    reach: dict[int, tuple[int, int]] = {}
    for left, right, members in repeat_groups([(r[4], r[5]) for r in rows]):
        for i in members[1:]:  # the first occurrence stays
            before = reach.get(i, (0, 0))
            reach[i] = (max(before[0], left), max(before[1], right))
    for i, (left, right) in reach.items():
        _, doc, sub, pos, _, _ = rows[i]
        out.append((doc, sub, pos - left, pos + right))


def _tree(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, then occurrence, to spans."""
    rows: list[tuple] = []
    out: list[tuple] = []

    def flush():
        b = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SPANS, strict=True)], schema=_SPANS)
        out.clear()
        return b

    for batch in it:
        for r in zip(*(batch.column(c).to_pylist() for c in _CTX.names), strict=True):
            if rows and rows[0][0] != r[0]:
                _group_spans(rows, out)
                rows = []
            if not rows or rows[-1][1:4] != r[1:4]:  # a repeated row is the same occurrence
                rows.append(r)
        if len(out) >= 50_000:
            yield flush()
    _group_spans(rows, out)
    if out:
        yield flush()


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out: list[tuple] = []
        for key, text, spans in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(),
                                    batch.column("spans"), strict=True):
            n = len(text)
            key = None if key == _NO_ID else key
            if spans.is_valid:
                packed = spans.values.to_numpy(zero_copy_only=False)
                a = packed >> 32
                e = np.minimum(packed & 0xFFFFFFFF, n)
                _, a, e = merge_spans(np.zeros(len(a), np.int64), np.maximum(a, 0), e)
                ends = [0, *e.tolist()]
                kept = b"".join(text[x:y] for x, y in zip(ends, [*a.tolist(), n], strict=True))
                out.append((key, n, n - len(kept), len(a), kept))
            else:
                out.append((key, n, 0, 0, text))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.binary(),), strict=True)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans (doc, sub, start, end) of bytes to remove, not merged. ``docs`` has
    doc (never null), sub (tells rows of one doc apart) and text as bytes."""
    rows = docs.mapInArrow(_local, "gram long, ctx long, doc long, sub long, start int, end int")
    order = Window.partitionBy("gram").orderBy("ctx", "doc", "sub", "start")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag(F.struct("ctx", "doc", "sub", "start")).over(order)
    rows = (rows.withColumn("_b", before)
            .withColumn("_many", F.count(F.lit(1)).over(whole))
            .withColumn("_mixed", F.first("ctx").over(whole) != F.last("ctx").over(whole)))
    itself = F.struct("doc", "sub", "start") == F.struct("_b.doc", "_b.sub", "_b.start")
    same = F.coalesce((F.col("_b.ctx") == F.col("ctx")) & ~itself, F.lit(False)) & (F.col("end") == 0)
    rows = rows.select(
        "gram", "doc", "sub", F.col("_many").alias("many"),
        F.when(same, F.col("start") - REACH).otherwise(F.col("start")).alias("start"),
        F.when(same, F.col("start") + MIN_BYTES).otherwise(F.col("end")).alias("end"), "_mixed")
    rows = materialize(rows.where((F.col("end") != 0) | F.col("_mixed")).drop("_mixed"), "repeat-anchors")
    known = rows.where(F.col("end") != 0).select("doc", "sub", "start", "end")
    spots = (rows.where(F.col("end") == 0).groupBy("doc", "sub")
             .agg(F.collect_set(F.struct("start", "gram", "many")).alias("spots")))
    around = (docs.join(spots, ["doc", "sub"])
              .mapInArrow(_contexts, "key long, doc long, sub long, pos int, left binary, right binary"))
    found = (around.repartition(F.col("key")).sortWithinPartitions("key", "doc", "sub", "pos")
             .mapInArrow(_tree, "doc long, sub long, start int, end int"))
    return known.unionByName(found)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans and
    the remaining bytes ``kept``."""
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), row_key("doc_id", "text").alias("sub"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    packed = F.shiftleft(F.greatest("start", F.lit(0)).cast("long"), 32).bitwiseOR(F.col("end").cast("long"))
    per = repeated_spans(base).groupBy("doc", "sub").agg(F.collect_list(packed).alias("spans"))
    return base.join(per, ["doc", "sub"], "left").select("doc", "text", "spans").mapInArrow(_cut, _KEPT)
