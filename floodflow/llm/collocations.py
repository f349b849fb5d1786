"""Collocations: frequent phrases of two to five words that score high.

Texts are lower-cased (A-Z), split at marks and line breaks into pieces and these
into words at blanks and tabs; everything is counted per language. Apriori, one
length after the other:

1. ``_code``: one pass cuts the texts into blocks of one language, with the block's
   own word numbers and counts. Words of at least ``least`` occurrences get a
   number; ``_recode`` keeps only those in each block and cuts it into rows of a few megabytes. The vocabulary travels in
   parts of bounded size, however large it is.
2. A phrase of k words can be frequent if its first and its last k - 1 words are
   (Apriori-safe). Its f is how often they begin at neighbouring positions: a task adds
   up the counts of its blocks, Spark those of the tasks, and sums from ``least`` on
   are the frequent phrases of k words.
3. The frequent phrases of one length are dealt by a hash of their words to double-array
   tries of at most about ``SHARD_PHRASES`` phrases each. They are broadcast in
   groups of at most ``GROUP_SHARDS``, whatever their number; every group is one
   pass over the blocks. A task moves the states of all positions of a block
   through the tries, one word of depth at a time; the accepting states say which
   phrase begins where. A position belongs to the one trie that its words hash to,
   so more tries cost more passes over the words but not more steps per position.
4. Scores, containment and ranks are joins and groupings of frequent phrases.

Defined cases: a null or empty text has no words; a null language counts as
``und``; rows that repeat count each time; a language without candidates gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodflow.llm.base import discard, materialize, release
from floodflow.llm.blocks import mix
from floodflow.llm.words import LOWER, Words, blocks, byte_class

LEAST = 100
LONGEST = 5
TOP = 2000
PART_BYTES = 32 << 20
#: Texts of a block, and those that are cut into words at once.
BATCH_BYTES, CUT_BYTES = 8 << 20, 2 << 20
#: A block's row has megabytes: a worker gets few at once, and a large one alone; Spark's
#: reader holds no more than a few on the heap.
ROW_BYTES, READ_ROWS = 4 << 20, 8
SLICE = 1 << 19
#: Counts in one Arrow batch, which an executor holds outside its heap.
COUNT_ROWS = 1 << 16
#: Counts that a task holds to add up those of its blocks.
MERGE_ROWS = 1 << 19
SHARD_PHRASES = 1 << 13
GROUP_SHARDS = 256
#: Ranks are taken in parts first, so that no task sorts all phrases of a language.
RANK_PARTS = 64
_MARKS = byte_class(b".,;:!?\n\x0b\x0c\r")
_BREAKS = _MARKS | byte_class(b" \t")


# --- words -----------------------------------------------------------------------

def _gathered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined up to about ``BATCH_BYTES``: fewer dictionaries, fewer counts."""
    kept, size = [], 0
    for batch in it:
        kept.append(batch)
        size += batch.nbytes
        if size >= BATCH_BYTES:
            yield pa.Table.from_batches(kept)
            kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def _code(docs: DataFrame) -> DataFrame:
    """One row per language of a batch of texts: its words with their counts, and the
    word numbers (places in ``words``, -1 between pieces) as int32. Texts are cut in
    parts of ``CUT_BYTES``, which share the numbers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(it):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                texts = batch.column("text").take(pa.array(np.flatnonzero(langs == lang))).to_pylist()
                number: dict[bytes, int] = {}
                counts, parts = np.empty(0, np.int64), []
                for a, b in blocks(texts, CUT_BYTES):
                    w = Words([t.translate(LOWER) for t in texts[a:b]], _BREAKS)
                    if not len(w.code):
                        continue
                    own = np.array([number.setdefault(x, len(number)) for x in w.vocabulary.to_pylist()], np.int64)
                    counts = np.r_[counts, np.zeros(len(number) - len(counts), np.int64)]
                    counts[own] += np.bincount(w.code, minlength=len(own))
                    marks = np.cumsum(_MARKS[w.data], dtype=np.int32)[w.start]
                    # A text ends with a blank in the joined bytes, which does not break pieces.
                    cut = np.r_[True, (marks[1:] != marks[:-1]) | (w.text[1:] != w.text[:-1])]
                    codes = np.full(len(w.code) + int(cut.sum()), -1, np.int32)
                    codes[np.arange(len(w.code)) + np.cumsum(cut)] = own[w.code]
                    parts.append(codes.tobytes())
                if not number:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()), pa.ListArray.from_arrays([0, len(number)], pa.array(number, pa.binary())),
                     pa.ListArray.from_arrays([0, len(counts)], pa.array(counts)),
                     pa.array([b"".join(parts)], pa.binary())], names=["lang", "words", "counts", "codes"])

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, words array<binary>, counts array<long>, codes binary")


def _recode(coded: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """Codes that count from 1 into ``ids`` (of frequent words), 0 is any other word or
    a break. The vocabulary of ``size`` bytes is broadcast in parts of about
    ``PART_BYTES``, each in one pass over the rows."""
    parts = max(1, -(-size // PART_BYTES))
    context = coded.sparkSession.sparkContext
    state = coded.select("lang", "words", "codes", F.lit(None).cast("binary").alias("ids"))
    words = vocabulary.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)))
    for part in range(parts):
        rows = words.where(F.col("part") == part).select("lang", "word", "id").toArrow()
        known = context.broadcast([rows.column(c).combine_chunks() for c in rows.column_names])
        last = part == parts - 1

        def run(it: Iterator[pa.RecordBatch], known=known, last=last) -> Iterator[pa.RecordBatch]:
            langs, word, number = known.value
            for batch in it:
                for lang, own, raw, before in zip(*(batch.column(c) for c in ("lang", "words", "codes", "ids")), strict=True):
                    # The block's words are hashed, which are few, and not the vocabulary.
                    place = pc.index_in(word, value_set=own.values)
                    mine = pc.indices_nonzero(pc.and_(pc.equal(langs, lang), place.is_valid()))
                    ids = np.full(len(own.values), -1, np.int64)
                    ids[place.take(mine).to_numpy()] = number.take(mine).to_numpy()
                    if before.is_valid:
                        ids = np.maximum(ids, np.frombuffer(before.as_buffer(), np.int64))
                    if not last:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang.as_py()], pa.string()), pa.ListArray.from_arrays([0, len(ids)], own.values),
                             pa.array([raw.as_py()], pa.binary()), pa.array([ids.tobytes()], pa.binary())],
                            names=["lang", "words", "codes", "ids"])
                        continue
                    table = np.zeros(len(ids) + 1, np.int32)  # the last entry, at -1, stays 0
                    often = ids >= 0
                    table[:-1][often] = np.arange(1, int(often.sum()) + 1)
                    names = np.r_[-1, ids[often]]
                    for codes in _pieces(table[np.frombuffer(raw.as_buffer(), np.int32)]):
                        there = np.zeros(len(names), bool)  # a piece has its own numbers, of its words alone
                        there[codes] = True
                        there[0] = False
                        codes = np.cumsum(there, dtype=np.int32)[codes]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([codes.tobytes()], pa.binary()), pa.array([names[there].tobytes()], pa.binary())],
                            names=["codes", "ids"])

        if last:
            out = materialize(state.mapInArrow(run, "codes binary, ids binary"), "collocation-codes", ROW_BYTES, READ_ROWS)
        else:
            state = materialize(state.mapInArrow(run, "lang string, words array<binary>, codes binary, ids binary"),
                                "collocation-parts", ROW_BYTES, READ_ROWS)
        known.destroy()
    return out


def _pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """``codes`` cut before zeros, which no phrase holds, into pieces of at most ``SLICE``
    positions, or up to the next zero where there is none."""
    zeros, start = np.flatnonzero(codes == 0), 0
    while len(codes) - start > SLICE:
        at = np.searchsorted(zeros, start + SLICE, side="right") - 1
        if at < 0 or zeros[at] <= start:
            at += 1
        if at >= len(zeros):
            break
        yield codes[start:zeros[at]]
        start = zeros[at]
    yield codes[start:]


def _slices(codes: np.ndarray, more: int) -> Iterator[tuple[int, np.ndarray]]:
    """Start and codes of slices of ``SLICE`` positions, with ``more`` codes after them."""
    for start in range(0, len(codes), SLICE):
        yield start, codes[start:start + SLICE + more]


# --- tries -----------------------------------------------------------------------

class Trie:
    """Double-array trie of phrases of one length.

    ``words`` are the sorted word ids that occur; a word's code is its place there.
    State 0 is the root; from state s the word of code c leads to t = base[s] + c if
    check[t] == s. ``phrase[t]`` is the phrase that ends in t.
    """

    def __init__(self, words: np.ndarray, base: np.ndarray, check: np.ndarray, phrase: np.ndarray):
        self.words, self.base, self.check, self.phrase = words, base, check, phrase

    @classmethod
    def build(cls, phrases: np.ndarray) -> Trie:
        """``phrases``: different rows of word ids, one phrase each."""
        n, length = phrases.shape
        words, code = np.unique(phrases, return_inverse=True)
        code = code.reshape(n, length)
        order = np.lexsort(code.T[::-1])
        code = code[order]
        size = 2 * n * length + len(words) + 64
        base, check, free = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.ones(size, bool)
        free[:len(words)] = False  # bases stay at 0 or above
        free[0] = False
        state = np.zeros(n, np.int64)
        for depth in range(length):
            new = np.r_[True, (state[1:] != state[:-1]) | (code[1:, depth] != code[:-1, depth])]
            rows = np.flatnonzero(new)  # one per child
            parent, letter = state[rows], code[rows, depth]
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            many = np.diff(np.r_[first, len(rows)])
            target = np.empty(len(rows), np.int64)
            for i in np.argsort(-many, kind="stable")[:int((many > 1).sum())]:
                a, b = first[i], first[i] + many[i]
                letters = letter[a:b] - letter[a]
                start = 0
                while True:
                    if start >= len(free):
                        grow = len(free)
                        base, check = np.r_[base, np.zeros(grow, np.int64)], np.r_[check, np.full(grow, -1)]
                        free = np.r_[free, np.ones(grow, bool)]
                    spots = start + np.flatnonzero(free[start:start + 4096])
                    spots = spots[(spots >= letter[a]) & (spots + letters[-1] < len(free))]
                    for c in letters[1:]:
                        spots = spots[free[spots + c]]
                        if not len(spots):
                            break
                    if len(spots):
                        break
                    start += 4096
                target[a:b] = spots[0] + letters
                free[target[a:b]] = False
            single = first[many == 1]
            if len(single):
                spots = np.flatnonzero(free)
                while len(spots) < len(single):
                    grow = len(free)
                    base, check = np.r_[base, np.zeros(grow, np.int64)], np.r_[check, np.full(grow, -1)]
                    free = np.r_[free, np.ones(grow, bool)]
                    spots = np.flatnonzero(free)
                target[single] = spots[:len(single)]
                free[target[single]] = False
            base[parent] = target - letter
            check[target] = parent
            state = target[np.cumsum(new) - 1]
        end = int(np.flatnonzero(~free)[-1]) + len(words) + 1
        phrase = np.full(end, -1, np.int32)
        fits = min(end, len(free))
        out_base, out_check = np.zeros(end, np.int32), np.full(end, -1, np.int32)
        out_base[:fits], out_check[:fits] = base[:fits], check[:fits]
        phrase[state] = order
        return cls(words.astype(np.int64), out_base, out_check, phrase)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Codes of word ids, -1 for words that no phrase has."""
        place = np.minimum(np.searchsorted(self.words, ids), max(len(self.words) - 1, 0))
        return np.where(self.words[place] == ids, place, -1)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states, -1 where no phrase goes on."""
        target = self.base[state].astype(np.int64) + code
        return np.where((code >= 0) & (self.check[target] == state), target, -1)


def _hash(columns: Iterable[np.ndarray], n: int) -> np.ndarray:
    """Hash of ``n`` phrases, from the columns of their word ids in order."""
    h = np.zeros(n, np.uint64)
    for column in columns:
        h = mix(h * np.uint64(31) + mix(column.astype(np.uint64)))
    return h


def _shards(phrases: DataFrame, length: int) -> tuple[DataFrame, int]:
    """Tries of the phrases (id, words), one row each, and their number."""
    total = phrases.count()
    shards = max(1, -(-total // SHARD_PHRASES))

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = np.asarray(batch.column("words").flatten()).reshape(-1, length)
            where = (_hash(ids.T, len(ids)) % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where)], names=["id", "words", "shard"])

    def build(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("words").combine_chunks().flatten()).reshape(-1, length)
        trie = Trie.build(ids)
        parts = (table.column("id").to_numpy(), trie.words, trie.base, trie.check, trie.phrase)
        return pa.table({"shard": table.column("shard")[:1],
                         "parts": pa.array([[x.tobytes() for x in parts]], pa.list_(pa.binary()))})

    rows = phrases.select("id", "words").mapInArrow(number, "id long, words array<long>, shard int")
    tries = rows.groupBy("shard").applyInArrow(build, "shard int, parts array<binary>")
    return materialize(tries, "collocation-tries", ROW_BYTES), shards


def _accept(codes: np.ndarray, ids: np.ndarray, length: int, shards: int, tries) -> Iterator[tuple]:
    """Per trie: positions of a block whose phrase it has, and the phrases' numbers."""
    n = len(codes) - length + 1
    if n <= 0:
        return  # no phrase fits, in this slice or any trie
    alive = codes[:n] > 0
    for d in range(1, length):
        alive &= codes[d:n + d] > 0
    at = np.flatnonzero(alive)
    if shards > 1:  # dealt to the tries once, so that one more trie costs its own positions only
        where = _hash((ids[codes[at + d] - 1] for d in range(length)), len(at)) % np.uint64(shards)
        where = where.astype(np.min_scalar_type(shards))
        order = np.argsort(where, kind="stable")
        at, where = at[order], where[order]
    for shard, parts in tries:
        trie = Trie(np.frombuffer(parts[1], np.int64), *(np.frombuffer(x, np.int32) for x in parts[2:]))
        place = at if shards == 1 else at[slice(*np.searchsorted(where, np.array([shard, shard + 1], where.dtype)))]
        letters = np.r_[-1, trie.codes(ids)] if len(place) > len(ids) else None
        state = np.zeros(len(place), np.int64)
        for d in range(length):
            word = codes[place + d]
            state = trie.step(state, trie.codes(ids[word - 1]) if letters is None else letters[word])
            go = state >= 0
            place, state = place[go], state[go]
        yield place, trie.phrase[state], np.frombuffer(parts[0], np.int64)


_COUNTS = "a long, b long, n long"
_Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _rows(counts: _Counts) -> Iterator[pa.RecordBatch]:
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in counts], names=["a", "b", "n"])
    for start in range(0, rows.num_rows, COUNT_ROWS):
        yield rows.slice(start, COUNT_ROWS)


def _pairs(left: np.ndarray, right: np.ndarray, names: np.ndarray) -> _Counts:
    """Counts of neighbours, numbers below 2 ** 31 turned into ``names``."""
    pair, n = np.unique((left.astype(np.int64) << 32) | right, return_counts=True)
    return names[pair >> 32], names[pair & 0xFFFFFFFF], n.astype(np.int64)


def _added(held: list[_Counts]) -> _Counts:
    a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][:len(a)])
    return a[first], b[first], np.add.reduceat(n, first) if len(first) else n


def _merged(counts: Iterable[_Counts]) -> Iterator[pa.RecordBatch]:
    """Equal pairs of a task's blocks added up, as long as at most ``MERGE_ROWS`` are held."""
    held: list[_Counts] = []
    size = 0
    for some in counts:
        held.append(some)
        size += len(some[0])
        if size > MERGE_ROWS:
            held = [_added(held)]
            size = len(held[0][0])
            if 2 * size > MERGE_ROWS:
                yield from _rows(held[0])
                held, size = [], 0
    if size:
        yield from _rows(_added(held))


def _word_pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two frequent words in a row, counted per block."""
    for batch in it:
        for raw, ids in zip(batch.column("codes"), batch.column("ids"), strict=True):
            names = np.r_[-1, np.frombuffer(ids.as_buffer(), np.int64)]
            for _, codes in _slices(np.frombuffer(raw.as_buffer(), np.int32), 1):
                both = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
                yield from _rows(_pairs(codes[both], codes[both + 1], names))


def _count(blocks: DataFrame, phrases: DataFrame, length: int, least: int) -> DataFrame:
    """How often phrase b begins one word after phrase a (column n), from ``least`` on."""
    tries, shards = _shards(phrases, length)
    spark = blocks.sparkSession
    state = blocks.withColumn("accepted", F.lit(None).cast("binary"))

    def located(raw, ids, before, group) -> Iterator[np.ndarray]:
        """Per slice: the phrase that begins at each position and at the one after, or -1."""
        whole, names = np.frombuffer(raw.as_buffer(), np.int32), np.frombuffer(ids.as_buffer(), np.int64)
        old = np.frombuffer(before.as_buffer(), np.int64) if before.is_valid else None
        for start, codes in _slices(whole, length):
            here = min(SLICE, len(whole) - start)
            found = np.full(here + 1, -1, np.int64)
            if old is not None:
                found[:len(old[start:start + here + 1])] = old[start:start + here + 1]
            for place, phrase, own in _accept(codes, names, length, shards, _each(group)):
                found[place] = own[phrase]
            yield found

    for first in range(0, shards, GROUP_SHARDS):
        rows = tries.where(F.col("shard").between(first, first + GROUP_SHARDS - 1)).toArrow()
        group = [spark.sparkContext.broadcast((shard, parts)) for shard, parts in
                 zip(rows.column("shard").to_pylist(), rows.column("parts").to_pylist(), strict=True)]

        def rows_of(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in it:
                yield from zip(batch.column("codes"), batch.column("ids"), batch.column("accepted"), strict=True)

        def run(it: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            def counts() -> Iterator[_Counts]:
                for row in rows_of(it):
                    for found in located(*row, group):
                        both = np.flatnonzero((found[:-1] >= 0) & (found[1:] >= 0))
                        near, code = np.unique(found[np.r_[both, both + 1]], return_inverse=True)
                        code = code.reshape(2, -1)
                        yield _pairs(code[0], code[1], near)

            return _merged(counts())

        def locate(it: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for raw, ids, before in rows_of(it):
                kept = b"".join(found[:-1].tobytes() for found in located(raw, ids, before, group))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raw.as_py()], pa.binary()), pa.array([ids.as_py()], pa.binary()), pa.array([kept], pa.binary())],
                    names=["codes", "ids", "accepted"])

        if first + GROUP_SHARDS >= shards:
            sums = state.mapInArrow(run, _COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n"))
            out = materialize(sums.where(F.col("n") >= least), f"collocation-counts-{length}", ROW_BYTES, READ_ROWS)
        else:
            state = materialize(state.mapInArrow(locate, "codes binary, ids binary, accepted binary"),
                                "collocation-states", ROW_BYTES, READ_ROWS)
        for b in group:
            b.destroy()
    discard(tries)
    release(spark)
    return out


def _each(group: list) -> Iterator[tuple]:
    """The tries of a group, one in a worker's memory at a time."""
    for b in group:
        yield b.value
        if len(group) > 1:
            del b._value


# --- phrases ---------------------------------------------------------------------

def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all word occurrences; (lang, words, k, f): frequent phrases of 1 to
    ``longest`` words, ``words`` an array of binaries."""
    coded = materialize(_code(docs), "collocation-blocks", ROW_BYTES)
    counted = coded.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    total = coded.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y))
                                      .alias("n"))
    vocabulary = materialize(
        counted.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
        .where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "collocation-words", ROW_BYTES, READ_ROWS)
    size = vocabulary.agg(F.sum(F.octet_length("word") + F.octet_length("lang") + 8)).first()[0] or 0
    known = _recode(coded, vocabulary, size)
    total = materialize(total, "collocation-totals", ROW_BYTES, READ_ROWS)
    discard(coded)
    release(docs.sparkSession)
    # Frequent phrases of the length at hand: id, lang, words (ids), text and, from two words on, f.
    now = vocabulary.select("id", "lang", F.array("id").alias("words"), F.array("word").alias("text"))
    found = vocabulary.select("lang", F.array("word").alias("words"), F.lit(1).alias("k"), "f")
    pairs = materialize(known.mapInArrow(_word_pairs, _COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n"))
                        .where(F.col("n") >= least), "collocation-pairs", ROW_BYTES, READ_ROWS)
    release(docs.sparkSession)
    for k in range(2, longest + 1):
        a, b = now.alias("a"), now.alias("b")
        grown = (pairs.join(a, F.col("a") == F.col("a.id")).join(b, F.col("b") == F.col("b.id"))
                 .select("a.lang", F.concat("a.words", F.slice("b.words", -1, 1)).alias("words"),
                         F.concat("a.text", F.slice("b.text", -1, 1)).alias("text"), F.col("n").alias("f"))
                 .withColumn("id", F.monotonically_increasing_id()))
        now = materialize(grown, f"collocation-phrases-{k}")
        if now.isEmpty():
            break
        found = found.unionByName(now.select("lang", F.col("text").alias("words"), F.lit(k).alias("k"), "f"))
        if k < longest:
            pairs = _count(known, now, k, least)
    return total, materialize(found, "collocation-found")


def _exact(*cols: str):
    """Product as a decimal of 38 digits."""
    out = F.lit(1).cast("decimal(1,0)")
    for c in cols:
        out = (out * F.col(c).cast("decimal(19,0)")).cast("decimal(38,0)")
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Per language the first ``top`` candidates: lang, rank, phrase, a, l, r, n, score.

    A candidate's score is that of its lowest cut (ties: the earliest); candidates
    inside a longer one that is as frequent are left out."""
    total, found = frequent_phrases(docs, least, longest)
    long = found.where("k > 1").select("lang", "words", "k", F.col("f").alias("a"))
    part = found.select("lang", "words", "f")
    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    head = part.withColumnsRenamed({"words": "head", "f": "l"})
    tail = part.withColumnsRenamed({"words": "tail", "f": "r"})
    cuts = (cuts.withColumn("head", F.slice("words", F.lit(1), F.col("cut")))
            .withColumn("tail", F.slice("words", F.col("cut") + 1, F.col("k")))
            .join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
            .join(F.broadcast(total) if total.count() <= 1000 else total, "lang"))
    cuts = (cuts.withColumn("_thousand", F.lit(1000))
            .withColumn("_over", _exact("_thousand", "a", "n")).withColumn("_under", _exact("l", "r"))
            .withColumn("score", F.expr("_over div _under")))
    best = cuts.groupBy("lang", "words", "k", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    # Every shorter phrase inside a candidate, with the largest f of those that hold it.
    inside = long.where("k > 2").select("lang", "a", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.slice("words", i, n)))))
        .alias("words")).groupBy("lang", "words").agg(F.max("a").alias("_holder"))
    kept = best.join(inside, ["lang", "words"], "left").where(
        F.col("_holder").isNull() | (F.col("_holder") < F.col("a")))
    rows = kept.select("lang", F.array_join(F.col("words").cast("array<string>"), " ").alias("phrase"), "a",
                       F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))) \
        .where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return rows.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
