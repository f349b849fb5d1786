"""Line dedup: exact set-similarity join of lines, removing later matches.

A line is the set of its lower-cased words. A line of ``min_words`` different
words or more is removed when an earlier line of as many (smaller doc_id, then
smaller place in the text) reaches Jaccard similarity ``PERCENT`` / 100 with it;
earlier lines count whether or not they are removed themselves. Shorter lines
stay. With ``min_words`` 1, as op6 and the pipeline call it, that leaves out only
lines without a word; sets too small to be similar to any but an equal one are
classes without a part in the join.

Words are ordered by rarity: their counts over all documents in
``BUCKETS`` hash buckets, a table of one byte each that is part of the plan and
whose size is fixed. Any total order gives the same result; a finer table only
saves candidates. The join takes 31 hash bits of each line's first ``n - ceil(t * n) + 1``
words, and of the smaller line only those that can be the first shared word of two lines of one
length, with the length filter, the positional filter of the first shared word and a filter on parity
bitmaps (bits that differ bound the symmetric difference from below) of 64 to 256
bits, more for longer lines, whose bitmaps of 64 bits would let most pairs pass;
surviving pairs are verified on the words' hashes
(64 bits) of both whole lines. Before it, each line is compared with the first
line of its three groups of equal ``LEAST`` outer words under other word orders; a line
that matches there is settled, and the join leaves out pairs of settled lines, so
a large group of near copies does not form all its pairs. No pair that could
settle an open line is left out. Lines with equal word
sets are one class; only its first line takes part in the join.

All steps are DataFrame functions.

Defined cases: null texts have no lines and stay null; a null doc_id sorts
before all others; rows that repeat id and text are one document and get equal
rows; empty lines stay. Extra columns are passed on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodflow.llm.base import discard, let, materialize, release, row_key, split_words

MIN_WORDS = 5  # default of the functions; the query and the pipeline pass 1
PERCENT = 80
BUCKETS = 1 << 16
MIDDLE, LONG = 32, 128  # lines of more words have parity bitmaps of 128 and of 256 bits
BITS = ("b0", "b1", "b2", "b3")
LEAST = 3  # words that lines with one leader have in common
BROADCAST_ROWS = 1_000_000  # most lines whose places are broadcast; for more, texts are joined by a shuffle
PASSES = 4  # parts of the words, joined one after the other: only one part's rows are on disk
_NO_ID = -(1 << 63)
_MASK = 0x3C6EF372FE94F82A


def _rarity(docs: DataFrame) -> bytes:
    """One byte per bucket: its count over all documents on a logarithmic scale."""
    scale = F.least(F.lit(127), F.floor(4 * F.log2(F.count("*") + 1))).cast("int")
    lines = docs.select(F.explode(_lines(F.col("text"))).alias("line"))
    rows = (lines.select(F.explode(_words(F.col("line"))).alias("w")).groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b"))
            .agg(scale.alias("r")).collect())  # BUCKETS rows at most
    out = bytearray(BUCKETS)
    for r in rows:
        out[r["b"]] = r["r"]
    return bytes(out)


def _words(line: Column) -> Column:
    """Lower-cased words of a line; a split at one character needs no regular expression."""
    odd = reduce(Column.__or__, [line.contains(c) for c in "\t\x0b\x0c\r"])
    return split_words(F.lower(F.when(odd, F.translate(line, "\t\x0b\x0c\r", " " * 4)).otherwise(line)), " ")


def _hashes(line: Column) -> Column:
    """Hashes of the different words of a line."""
    return F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))


def _ordered(words: Column, rarity: bytes) -> Column:
    """The words as numbers whose order is rarity, then hash: 7 bits and 56 bits. The
    numbers are known not to be null, so they are sorted as plain numbers."""
    # Texts of numbers become one array when Spark plans the query.
    table = F.split(F.lit(",".join(map(str, rarity))), ",").cast("array<int>").cast("array<long>")
    return F.sort_array(F.transform(words, lambda h: F.shiftleft(
        F.coalesce(F.get(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("long")), 56)
        .bitwiseOR(F.shiftrightunsigned(h, 8))))


def _parity(h: Column, mask: int = 0) -> Column:
    """Parity bitmap of the words that have all bits of ``mask``."""
    mine = F.filter(h, lambda x: x.bitwiseAND(F.lit(mask)) == mask) if mask else h
    return F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))


def _other_order(w: Column) -> Column:
    """The words' hashes in an order that is not their own."""
    return F.sort_array(F.transform(w, lambda x: x.bitwiseXOR(F.lit(_MASK))))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_sets(docs: DataFrame, rarity: bytes) -> DataFrame:
    """All lines with a character: doc, rk, no, set (hash of the word set), n, BITS (parity
    bitmaps: of all words, of more than MIDDLE words also that of half of them, of more than
    LONG also those of two quarters), pre, sigs.

    Every step is a projection of its own, so no array is made twice."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
                       row_key("doc_id", "text").alias("rk"), F.posexplode(_lines(F.col("text"))).alias("no", "line"))
    keys = ["doc", "rk", "no"]
    rows = base.where(F.length("line") > 0).select(*keys, _hashes(F.col("line")).alias("w"))
    rows = rows.select(*keys, _ordered(F.col("w"), rarity).alias("h"), F.size("w").alias("n"),
                       F.sort_array("w").alias("o0"), _other_order(F.col("w")).alias("o1"))
    h, n = F.col("h"), F.col("n")
    quarters = [F.when(n > LONG, _parity(h, mask)) for mask in (128, 192)]
    return rows.select(
        *keys, F.xxhash64("h").alias("set"), "n", _parity(h).alias("b0"), F.when(n > MIDDLE, _parity(h, 64)).alias("b1"),
        F.when(n > LONG, quarters[0].bitwiseXOR(quarters[1])).alias("b2"), quarters[1].alias("b3"),
        F.transform(F.slice(h, 1, n - F.ceil(n * PERCENT / 100).cast("int") + 1),
                    lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("pre"),
        F.array(F.hash(F.lit(0), F.slice("o0", 1, LEAST)),  # first and last words, and the first of another order
                F.hash(F.lit(1), F.slice("o0", F.greatest(n - LEAST, F.lit(0)) + 1, LEAST)),
                F.hash(F.lit(2), F.slice("o1", 1, LEAST))).alias("sigs"))


def _near(a: str, b: str) -> Column:
    """Whether length and parity bitmaps leave the similarity possible: bits that differ are
    at most the size of the symmetric difference. Both sides have n and BITS; the finest
    bitmaps that both have are compared."""
    d = [F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in BITS]
    half = d[0].bitwiseXOR(d[1])
    far = F.coalesce(
        F.bit_count(half.bitwiseXOR(d[2])) + F.bit_count(d[1].bitwiseXOR(d[3])) + F.bit_count(d[2]) + F.bit_count(d[3]),
        F.bit_count(half) + F.bit_count(d[1]), F.bit_count(d[0]))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * far <= (100 - PERCENT) * (n + m))


def _leaders(lines: DataFrame) -> DataFrame:
    """Pairs (early, late): each class and the first class of each of its ``sigs``."""
    rows = lines.select("set", "doc", "no", "rk", "n", *BITS, F.explode("sigs").alias("s"))
    lead = (rows.groupBy("s").agg(F.min(F.struct("doc", "no", "rk", "set", "n", *BITS)).alias("lead"),
                                  F.min("set").alias("lo"), F.max("set").alias("hi"))
            .where("lo < hi").select("s", "lead.*"))
    x, y = lead.alias("x"), rows.select("set", "n", *BITS, "s").alias("y")
    return (x.join(y, F.col("x.s") == F.col("y.s")).where((F.col("x.set") != F.col("y.set")) & _near("x", "y"))
            .select(F.col("x.set").alias("early"), F.col("y.set").alias("late")).distinct())


def _candidates(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of classes that pass the filters and whose later class is not yet in ``found``
    (either, where both begin in documents of one id)."""
    known = found.select(F.col("late").alias("set"), F.lit(False).alias("open"))
    classes = materialize(
        lines.groupBy("set").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("n", *BITS, "pre")])
        .join(known, "set", "left").withColumn("open", F.coalesce("open", F.lit(True))), "line-classes")
    spots = classes.select(F.posexplode("pre").alias("pos", "t"), "set", "doc", "n", *BITS, "open")
    parts = []
    for part in range(PASSES):
        mine = spots.where(F.pmod("t", F.lit(PASSES)) == part)
        early = (100 + PERCENT) * (F.col("n") - F.col("pos")) >= 2 * PERCENT * F.col("n")
        few, rest = mine.where(early), mine.where(~early)
        parts.append(materialize(_meeting(few, few).union(_meeting(few, rest)).distinct(), "line-meetings"))
    discard(classes)
    return reduce(DataFrame.union, parts).distinct()


def _meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of a class of ``a`` and one in ``b`` of more words (or as many and a larger hash) that
    share a word which can be their first shared one: all others come after it on both sides, so the
    smaller class has it among the words that leave 2 * PERCENT / (100 + PERCENT) of it."""
    a, b = a.alias("a"), b.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    reach = F.least(n - F.col("a.pos"), m - F.col("b.pos"))
    return (a.join(b, (F.col("a.t") == F.col("b.t")) & (n <= m) & (100 * n >= PERCENT * m)
                   & ((100 + PERCENT) * reach >= PERCENT * (n + m)) & ((n < m) | (F.col("a.set") < F.col("b.set")))
                   & ((F.col("a.open") & (F.col("a.doc") >= F.col("b.doc")))
                      | (F.col("b.open") & (F.col("b.doc") >= F.col("a.doc"))))
                   & _near("a", "b"))
            .select(F.col("a.set").alias("x"), F.col("b.set").alias("y")))


def _ordered_pairs(lines: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (early, late), without those whose late class is in ``found``."""
    ends = pairs.select(F.col("x").alias("set")).union(pairs.select("y")).distinct()
    firsts = (lines.select("set", "doc", "no", "rk").join(ends, "set", "left_semi")
              .groupBy("set").agg(F.min(F.struct("doc", "no", "rk")).alias("first")))
    pairs = (pairs.select(F.col("x").alias("set"), "y").join(firsts, "set")
             .select(F.col("set").alias("x"), F.col("first").alias("fx"), F.col("y").alias("set"))
             .join(firsts, "set"))
    before = F.col("fx") < F.col("first")
    return (pairs.select(F.when(before, F.col("x")).otherwise(F.col("set")).alias("early"),
                         F.when(before, F.col("set")).otherwise(F.col("x")).alias("late"))
            .join(found, "late", "left_anti"))


def _verified(docs: DataFrame, lines: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Classes ``late`` that reach the similarity with the ``early`` one of a pair."""
    pairs = materialize(pairs, f"line-{name}-pairs")
    wanted = pairs.select(F.col("early").alias("set")).union(pairs.select("late")).distinct()
    firsts = (lines.select("set", "doc", "no", "rk").join(wanted, "set", "left_semi")
              .groupBy("set").agg(F.min(F.struct("doc", "no", "rk")).alias("first")))
    spots = (firsts.select("set", "first.no", "first.rk")
             .groupBy("rk").agg(F.collect_list(F.struct("set", "no")).alias("spots")))
    spots = materialize(spots, f"line-{name}-spots")
    # Only the wanted lines' words are moved as long as the places can be broadcast. Rows of one
    # key are one text, and give the same words.
    many = spots.agg(F.sum(F.size("spots"))).first()[0] or 0
    keyed = docs.select(row_key("doc_id", "text").alias("rk"), "text")
    rows = keyed.join(F.broadcast(spots) if many <= BROADCAST_ROWS else spots, "rk")
    own = let(_lines(F.col("text")), lambda lines: F.transform("spots", lambda s: F.struct(
        s["set"].alias("set"), F.element_at(lines, s["no"] + 1).alias("line"))))
    words = (rows.select(F.explode(own).alias("s")).select("s.set", _hashes(F.col("s.line")).alias("w"))
             .dropDuplicates(["set"]))
    words = materialize(words, f"line-{name}-words")
    e = words.select(F.col("set").alias("early"), F.col("w").alias("we"))
    y = words.select(F.col("set").alias("late"), F.col("w").alias("wl"))
    same = F.size(F.array_intersect("we", "wl"))
    hits = (pairs.join(e, "early").join(y, "late")
            .where((100 + PERCENT) * same >= PERCENT * (F.size("we") + F.size("wl")))
            .select("late").distinct())
    hits = materialize(hits, f"line-{name}-hits")
    for scratch in (pairs, spots, words):
        discard(scratch)
    release(docs.sparkSession)
    return hits


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document key ``rk`` with the numbers ``gone`` of its removed lines."""
    lines = materialize(line_sets(docs, _rarity(docs)), "line-sets")
    release(docs.sparkSession)
    lines = lines.where(F.col("n") >= max(min_words, 1))
    # Two different sets reach the similarity at best when one has a word more.
    able = lines.where(100 * F.col("n") >= PERCENT * (F.col("n") + 1))
    # One match is enough to remove a line. Leaders settle large groups of near
    # copies in linear work; the join below leaves out pairs of settled classes.
    found = _verified(docs, able, _leaders(able), "leader")
    pairs = materialize(_candidates(able, found), "line-candidates")
    hits = _verified(docs, able, _ordered_pairs(able, pairs, found), "join")
    discard(pairs)
    near = (found.union(hits).select(F.col("late").alias("set")).distinct()
            .withColumn("late", F.lit(True)))
    state = lines.groupBy("set").agg(F.min(F.struct("doc", "no", "rk")).alias("first")).join(near, "set", "left")
    gone = (lines.select("doc", "rk", "no", "set").join(state, "set")
            .where(F.col("late") | (F.struct("doc", "no", "rk") != F.col("first"))))
    gone = materialize(gone.groupBy("rk").agg(F.collect_set("no").alias("gone")), "line-gone")
    discard(lines)
    release(docs.sparkSession)
    return gone


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the removed lines cut from ``text``, and ``n_lines`` and
    ``n_removed`` added. Lines of fewer than ``min_words`` different words stay."""
    gone = removed_lines(docs, min_words)
    rows = docs.select(F.struct("*").alias("_doc"), row_key("doc_id", "text").alias("rk")).join(gone, "rk", "left")
    lines = F.col("_l")
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(F.col("gone"), i), x)),
                    lambda x: x.isNotNull())
    rows = rows.withColumn("_l", _lines(F.col("_doc.text")))
    text = F.when(F.col("gone").isNull(), F.col("_doc.text")).otherwise(F.array_join(kept, "\n"))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return rows.select(*[F.col("_doc").getField(c).alias(c) for c in names], text.alias("text"),
                       F.coalesce(F.size("_l"), F.lit(0)).cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
