"""N-gram Jaccard join with multiple-global-order filtering.

A document's set holds its distinct shingles. Two sets that reach the
similarity must share a token among the first ``n - ceil(t * n) + 1`` tokens of
both, under *any* order of all tokens. The orders used here put tokens that
many documents share last (counted over all documents, but in a map batch only
where ``_LOCAL`` of its documents share them) and break ties by
differently seeded hashes, so boilerplate stays out of the prefixes. The first
order generates candidates by an equi-join on prefix tokens, with length and
positional bounds. Only texts of candidate pairs are read again, turn by turn. Their
prefixes under the other orders are kept as 31-bit hashes, and a pair must share a token under
each of them: the filters are intersected on the pairs, before any text is sent to
be verified.

Documents with equal sets form one class and are compared once. Only
connectivity is asked for, so a bucket of k classes first yields k - 1 pairs
with its most central class (the one whose prefix is shared most); pairs that
the links found so far already connect are not compared, and what the stars
leave unconnected is paired in full. Pairs must also pass a sketch, a parity bitmap or,
for large sets, a table of counts: bits that differ, or the distance of the counts,
bound the symmetric difference from below,
so near copies that are not similar enough end there. No link between different components is
lost, whatever the size of a bucket, and no cap applies.

Shingle hashes have 64 bits; a class is told by a 64-bit hash of its set.

Defined cases: null, empty and blank texts have an empty set, no links and are
their own component; a null doc_id is smaller than all others and reported as
null; rows that repeat an id are separate members of the graph, with the same
id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodflow.llm.base import discard, materialize, release, row_key
from floodflow.llm.blocks import Block, batches, mix, word_spans
from floodflow.llm.components import components

SHINGLE = 4  # op5's contract
PERCENT = 85
ORDERS = (0x0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Most frequent shingles that the orders put last: the bound of the only broadcast.
FREQUENT = 200_000
_FRONTS = [f"front{k}" for k in range(1, len(ORDERS))]
_LOCAL = 4  # a map batch reports shingles that so many of its documents share
_STARS = 2
PASSES = 4  # parts of the tokens, dealt to buckets one after the other: only one part's rows are on disk
_WORDS = 8  # 64-bit words of a parity bitmap
_CELLS = 128  # bytes of a table of counts
#: Larger sets have a table of counts, sets above the second bound no parity bitmap, which
#: says nothing about them. Similar sets on two sides of a bound have one sketch in common.
_LARGE = (1024, 1536)
#: Most rows of a broadcast that picks the texts of a turn; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_NO_ID = -(1 << 63)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_C = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order."""
    for a, b in batches(texts):
        block = Block([t.translate(_LOWER) for t in texts[a:b]])
        start, end, text = word_spans(block)
        h = block.range_hash(start, end)
        count = np.bincount(text, minlength=b - a)
        width = np.minimum(count, size)
        g, n = h.copy(), len(h)
        for j in range(1, size):
            more = np.flatnonzero((width[text] > j) & (np.arange(n) + j < n))
            g[more] = mix(g[more] * _C + h[more + j])
        first = np.cumsum(count) - count
        # a shingle starts at every word that has enough followers in its text
        keep = np.arange(n) - first[text] <= (count - width)[text]
        g, text = g[keep] ^ (width[text[keep]].astype(np.uint64) * _C), text[keep]
        o = np.lexsort((g, text))
        g, text = g[o], text[o]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
        g, text = g[new], text[new]
        at = np.searchsorted(text, np.arange(b - a + 1))
        for i in range(b - a):
            yield g[at[i]:at[i + 1]]


class Orders:
    """The global token orders; ``hashes`` (sorted) are the frequent shingles of
    ``size`` words, and prefixes are those of ``percent``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE, percent: int = PERCENT):
        self.hashes, self.counts, self.size, self.percent = hashes, counts, size, percent

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        return shingle_sets(texts, self.size)

    def frequency(self, s: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(s), np.int64)
        i = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
        return np.where(self.hashes[i] == s, self.counts[i], 0)

    def prefix(self, s: np.ndarray, order: int, freq: np.ndarray | None = None) -> np.ndarray:
        n = len(s)
        freq = self.frequency(s) if freq is None else freq
        take = n - (self.percent * n + 99) // 100 + 1
        rare = s[freq == 0]
        if len(rare) >= take:  # the usual case needs no full sort
            k = mix(rare ^ np.uint64(ORDERS[order]))
            at = np.argpartition(k, take - 1)[:take]
            return rare[at[np.argsort(k[at])]]
        return s[np.lexsort((mix(s ^ np.uint64(ORDERS[order])), freq))[:take]]


def _bytes(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit("")).cast("binary").alias("text")


def _count_frequent(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        sets = list(shingle_sets(batch.column("text").to_pylist(), size))
        h, c = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
        many = c >= _LOCAL
        yield pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(c[many])], names=["h", "c"])


def frequent_shingles(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> Orders:
    """The ``FREQUENT`` shingles that most documents share, counted over all.

    Only shingles that ``_LOCAL`` documents of one map batch share are counted;
    this bounds the shuffle, and any order gives the same result.
    """
    rows = (docs.select(_bytes()).mapInArrow(lambda it: _count_frequent(it, size), "h long, c long")
            .groupBy("h").agg(F.sum("c").alias("c"))
            .orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow())
    h = rows.column("h").to_numpy().view(np.uint64)
    o = np.argsort(h)
    return Orders(h[o], rows.column("c").to_numpy()[o].astype(np.int64), size, percent)


def signatures(docs: DataFrame, orders: Orders) -> DataFrame:
    """Per row: doc, rk, n (set size), cls (hash of the set), pre (first order's
    prefix), score (share of frequent shingles in it), bits (parity bitmap, not of very
    large sets) and cells (counts, of large sets only)."""
    shared = docs.sparkSession.sparkContext.broadcast((orders.hashes, orders.counts, orders.size, orders.percent))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Orders(*shared.value)
        for batch in it:
            n, cls, pre, score, bits, cells = [], [], [], [], [], []
            for s in own.sets(batch.column("text").to_pylist()):
                n.append(len(s))
                cls.append(int(mix(np.array([mix(s).sum() ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0]))
                front = own.prefix(s, 0) if len(s) else s
                pre.append(front.view(np.int64))
                score.append(float((own.frequency(front) > 0).mean()) if len(s) else 0.0)
                bits.append(parity(s) if len(s) <= _LARGE[1] else None)
                cells.append(counts(s) if len(s) > _LARGE[0] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("rk"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()),
                 pa.array(pre, pa.list_(pa.int64())), pa.array(score, pa.float64()),
                 pa.array(bits, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int8()))],
                names=["doc", "rk", "n", "cls", "pre", "score", "bits", "cells"])

    return (docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
                        row_key("doc_id", "text").alias("rk"), _bytes())
            .mapInArrow(run, "doc long, rk long, n long, cls long, pre array<long>, score double, bits array<long>, "
                             "cells array<byte>"))


def parity(s: np.ndarray) -> np.ndarray:
    """Per bit whether an odd number of the set's shingles hash to it."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * _WORDS - 1), minlength=64 * _WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def counts(s: np.ndarray) -> np.ndarray:
    """How many of the set's shingles hash to each cell, modulo 256."""
    n = np.bincount((s >> np.uint64(34)).astype(np.int64) & (_CELLS - 1), minlength=_CELLS)
    return (n & 255).astype(np.uint8).view(np.int8)


def _near(x: str, y: str, nx: str, ny: str, percent: int) -> Column:
    """Whether the sketches of two sides (columns ``x``bits, ``x``cells) leave the similarity
    possible: bits that differ, and the distance of the counts, are at most the size of the
    symmetric difference."""
    most = (100 - percent) * (F.col(nx) + F.col(ny))
    differ = sum(F.bit_count(F.col(f"{x}bits")[i].bitwiseXOR(F.col(f"{y}bits")[i])) for i in range(_WORDS))
    apart = F.zip_with(f"{x}cells", f"{y}cells", lambda a, b: F.abs(a.cast("int") - b.cast("int")))
    apart = F.aggregate(apart, F.lit(0), lambda sum_, d: sum_ + F.least(d, 256 - d))
    return (F.coalesce((100 + percent) * differ <= most, F.lit(True))
            & F.coalesce((100 + percent) * apart <= most, F.lit(True)))


def _fits(n1: str, p1: str, n2: str, p2: str, percent: int) -> Column:
    """Length bound and positional bound of a pair's first shared token, at places p1 and
    p2: all that the sets share comes from there on. Similar sets meet the bound at that
    token, whatever the later ones do."""
    a, b, i, j = (F.col(x) for x in (n1, n2, p1, p2))
    return ((100 * F.least(a, b) >= percent * F.greatest(a, b))
            & ((100 + percent) * F.least(a - i, b - j) >= percent * (a + b)))


def _verify(it: Iterator[pa.RecordBatch], orders: Orders) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, part, role): a hub's own text, then its partners."""
    hub, own = None, None
    for batch in it:
        hubs, roles, cls = (batch.column(c).to_pylist() for c in ("hub", "role", "cls"))
        u, v = [], []
        for h, role, c, s in zip(hubs, roles, cls, orders.sets(batch.column("text").to_pylist()), strict=True):
            if role == 0:
                hub, own = h, s
                continue
            if h != hub:
                raise ValueError("a partner without its hub")
            both = int(np.isin(s, own, assume_unique=True).sum())
            if 100 * both >= orders.percent * (len(s) + len(own) - both):
                u.append(h)
                v.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _with_fronts(texts: DataFrame, orders: Orders) -> DataFrame:
    """``texts`` (cls, text) with the prefixes under all orders but the first."""
    shared = texts.sparkSession.sparkContext.broadcast((orders.hashes, orders.counts, orders.size, orders.percent))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Orders(*shared.value)
        for batch in it:
            fronts: list[list] = [[] for _ in _FRONTS]
            for s in own.sets(batch.column("text").to_pylist()):
                freq = own.frequency(s)
                for k, out in enumerate(fronts, 1):
                    out.append((own.prefix(s, k, freq) & np.uint64(0x7FFFFFFF)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(f, pa.list_(pa.int32())) for f in fronts]], names=["cls", "text", *_FRONTS])

    kind = "cls long, text binary, " + ", ".join(f"{f} array<int>" for f in _FRONTS)
    return texts.mapInArrow(run, kind)


def _texts(docs: DataFrame, marks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls, text) of the classes in ``pairs``: of all texts, only these are moved as long
    as their keys can be broadcast."""
    ends = pairs.select("cls").union(pairs.select("hub")).distinct()
    wanted = materialize(marks.select("cls", "rk").join(ends, "cls", "left_semi"), "shingle-wanted")
    keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    # Rows of one key are one text.
    return (docs.select(row_key("doc_id", "text").alias("rk"), _bytes()).join(keys, "rk")
            .dropDuplicates(["rk"]).select("cls", "text"))


def _share(pairs: DataFrame, fronts: DataFrame) -> DataFrame:
    """The pairs (hub, cls) whose prefixes meet under every other order too."""
    hub = fronts.select(F.col("cls").alias("hub"), *[F.col(f).alias(f"hub_{f}") for f in _FRONTS])
    meet = F.lit(True)
    for f in _FRONTS:
        meet = meet & F.arrays_overlap(f, f"hub_{f}")
    return pairs.join(fronts, "cls").join(hub, "hub").where(meet).select("hub", "cls")


def verified(pairs: DataFrame, texts: DataFrame, orders: Orders) -> DataFrame:
    """The pairs (hub, cls) that link. A hub's text travels once for every part
    of about 200 partners, so no group of partners is one task's alone."""
    shared = texts.sparkSession.sparkContext.broadcast((orders.hashes, orders.counts, orders.size, orders.percent))
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("k"))
    pairs = (pairs.join(sizes, "hub").withColumn(
        "part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("k") / 200))).drop("k"))
    rows = (pairs.select("hub", "part", F.lit(1).alias("role"), "cls")
            .unionByName(pairs.select("hub", "part", F.lit(0).alias("role"),
                                      F.col("hub").alias("cls")).distinct()))
    return (rows.join(texts, "cls").repartition(F.col("hub"), F.col("part"))
            .sortWithinPartitions("hub", "part", "role")
            .select("hub", "role", "cls", "text")
            .mapInArrow(lambda it: _verify(it, Orders(*shared.value)), "u long, v long"))


def join_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, rk, n_shingles, component_id, and
    ``first``, the key of the component's row with the smallest (id, rk). Rows link
    when their sets of ``size`` words a shingle reach ``percent``."""
    docs = docs.select("doc_id", "text")
    orders = frequent_shingles(docs, size, percent)
    rows = materialize(signatures(docs, orders), "shingle-sets")
    named = rows.select("doc", "rk", "n", "cls")
    named = materialize(named, "shingle-rows")
    reps = named.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc", "rk")).alias("rep"))
    reps = reps.select("cls", F.col("rep.rk").alias("rep"))
    # Dealt by the class alone (a key is equal if it is neither smaller nor larger), rows move
    # once for the join and the choice among rows that repeat.
    classes = (rows.where("n > 0").join(reps, "cls").where(F.col("rk").between(F.col("rep"), F.col("rep")))
               .dropDuplicates(["cls"])
               .select("cls", "rk", "n", "pre", "score", "bits", "cells"))
    classes = materialize(classes, "shingle-classes")
    discard(rows)
    rows = named
    release(docs.sparkSession)

    # buckets of two and more classes
    open_ = _buckets(classes)
    marks = classes.select("cls", "rk", "n", "bits", "cells").join(open_.select("cls").distinct(), "cls", "left_semi")
    marks = materialize(marks, "shingle-marks")
    discard(classes)
    release(docs.sparkSession)

    edges = tried = comp = None
    for turn in range(_STARS + 1):
        pairs = (_star_pairs(open_, marks, turn, percent) if turn < _STARS
                 else _all_pairs(open_, marks, percent))
        if tried is not None:
            pairs = pairs.join(tried, [F.least(pairs.hub, pairs.cls) == tried.x,
                                       F.greatest(pairs.hub, pairs.cls) == tried.y], "left_anti")
        pairs = materialize(pairs, "shingle-tries")
        ends = pairs.select(F.least("hub", "cls").alias("x"), F.greatest("hub", "cls").alias("y"))
        tried = ends if tried is None else tried.unionByName(ends)
        texts = materialize(_with_fronts(_texts(docs, marks, pairs), orders), "shingle-texts")
        pairs = materialize(_share(pairs, texts.select("cls", *_FRONTS)), "shingle-pairs")
        new = materialize(verified(pairs, texts.select("cls", "text"), orders), "shingle-links")
        discard(texts)
        edges = new if edges is None else edges.unionByName(new)
        comp = materialize(components(edges), "shingle-components").withColumnRenamed("node", "cls")
        release(docs.sparkSession)
        if turn < _STARS:  # links only join components: a bucket that is one stays one
            known = open_.drop("comp").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
            split = known.groupBy("t").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b")
            before, open_ = open_, materialize(known.join(split.select("t"), "t"), "shingle-open")
            discard(before)
            if open_.isEmpty():
                break
    discard(open_)
    discard(marks)

    named = (named.where("n > 0").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    least = named.groupBy("comp").agg(F.min(F.struct("doc", "rk")).alias("least"))
    linked = named.join(least, "comp").select(
        "rk", "doc", "n", F.col("least.doc").alias("component"), F.col("least.rk").alias("first"))
    alone = rows.where("n = 0").select("rk", "doc", "n", F.col("doc").alias("component"), F.col("rk").alias("first"))
    null = F.lit(None).cast("long")
    return linked.unionByName(alone).select(
        F.when(F.col("doc") != _NO_ID, F.col("doc")).otherwise(null).alias("doc_id"), "rk",
        F.col("n").alias("n_shingles"),
        F.when(F.col("component") != _NO_ID, F.col("component")).otherwise(null).alias("component_id"), "first")


def _buckets(classes: DataFrame) -> DataFrame:
    """(t, cls, n, score, pos, comp) of the prefix tokens t that two classes or more have."""
    spots = classes.select("cls", "n", "score", F.posexplode("pre").alias("pos", "t"))
    parts = []
    for part in range(PASSES):
        mine = spots.where(F.pmod("t", F.lit(PASSES)) == part)
        busy = mine.groupBy("t").agg(F.count("*").alias("k")).where("k > 1").select("t")
        parts.append(materialize(mine.join(busy, "t").withColumn("comp", F.col("cls")), "shingle-buckets"))
    return reduce(DataFrame.unionByName, parts)


def _star_pairs(spots: DataFrame, marks: DataFrame, turn: int, percent: int) -> DataFrame:
    """Every class with the hub that most of its buckets agree on.

    A bucket's hub is its most central class; in later turns, the most central
    one outside the component of that.
    """
    rank = F.struct("score", "cls", "n", "pos", "comp")
    hubs = spots.groupBy("t").agg(F.max(rank).alias("hub"))
    if turn % 2:
        rest = spots.join(hubs, "t").where(F.col("comp") != F.col("hub.comp")).drop("hub")
        hubs = rest.groupBy("t").agg(F.max(rank).alias("hub"))
    votes = (spots.join(hubs, "t").where(F.col("comp") != F.col("hub.comp"))
             .select("cls", "n", "pos", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hn"),
                     F.col("hub.pos").alias("hpos"), F.col("hub.score").alias("hscore"))
             .where(_fits("n", "pos", "hn", "hpos", percent))
             .groupBy("cls", "hub").agg(F.count("*").alias("c"), F.max("hscore").alias("s")))
    own = marks.select("cls", "n", "bits", "cells")
    hub = marks.select(F.col("cls").alias("hub"), F.col("n").alias("hn"), F.col("bits").alias("hbits"),
                       F.col("cells").alias("hcells"))
    return (votes.join(own, "cls").join(hub, "hub").where(_near("", "h", "n", "hn", percent))
            .groupBy("cls").agg(F.max(F.struct("c", "s", "hub")).alias("b"))
            .select(F.col("b.hub").alias("hub"), "cls"))


def _all_pairs(spots: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """All pairs of a bucket that lie in different components and may be similar."""
    b = spots.select("t", "cls", "pos", "comp").join(marks.select("cls", "n", "bits", "cells"), "cls")
    a = b.select("t", F.col("cls").alias("hub"), F.col("n").alias("hn"), F.col("pos").alias("hpos"),
                 F.col("comp").alias("hcomp"), F.col("bits").alias("hbits"), F.col("cells").alias("hcells"))
    return (a.join(b, (a["t"] == b["t"]) & (F.col("hub") < F.col("cls")) & (F.col("comp") != F.col("hcomp"))
                   & _fits("n", "pos", "hn", "hpos", percent) & _near("", "h", "n", "hn", percent))
            .select("hub", "cls").distinct())
