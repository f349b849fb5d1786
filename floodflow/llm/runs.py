"""Periodic runs of words, found on a grammar.

A run is a longest stretch of words with smallest period ``q`` and a length of at
least ``max(6, 4 * q)``. Documents are cut into blocks inside a task and every
document gets a Re-Pair grammar of its own:

1. ``repair`` replaces pairs that occur at least twice by nonterminals. In each
   round every pair that outranks the pairs it overlaps goes at once (by count,
   then by number); those do not touch each other, so this is the order of most
   frequent pairs first, done for all places and documents together. What is left
   of a document is its start sequence, read as a balanced tree.
2. Each nonterminal, and each node of that tree, has one boundary and one window
   of text (of a nonterminal: its first place). A run that lies in the window and
   crosses the boundary is found from four questions per power of two ``size``:
   where do the ``size`` words at, around or before the boundary occur next? For a
   run of period in ``size / 2 .. size`` one of the answers is its period, since
   fewer than ``period`` words further they cannot occur again.
3. A run of a nonterminal is moved to all places where that nonterminal derives
   (``places`` only follows symbols with a run below them).
4. Of the intervals with one period those inside another one go. The longest is
   always there: it crosses the boundary of the lowest node that holds it.

Nothing is shuffled: a document's result needs that document alone.

Defined cases: a null text is empty; a text without words has no run, null run
columns and the hashes of nothing; a null ``doc_id`` has no checksum and its words
are not changed by ``planted``; rows that repeat get equal results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodflow.llm.words import Words, blocks

LEAST_WORDS = 6
LEAST_PERIODS = 4


def _renumber(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of keys, and how often each number occurs."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number.reshape(-1), count


class Grammar:
    """Rules ``left[x], right[x]`` of the symbols from ``terminals`` on; ``size``
    in words, ``first`` place, ``round`` in which the rule was made; ``symbol`` is
    the symbol that starts at a position and ``heads`` the start sequence."""

    def __init__(self, words: np.ndarray, same: np.ndarray):
        """``words`` numbers from 0, different in different documents; ``same[i]``
        tells whether positions i and i + 1 are of one document."""
        self.terminals = int(words.max()) + 1 if len(words) else 0
        self.symbol = words.copy()
        none = np.empty(0, np.int64)
        self.left, self.right, self.first, self.round = none, none, none, none
        self.size = np.ones(self.terminals, np.int64)
        self.alive = np.ones(len(words), bool)
        self._repair(same)
        self.heads = np.flatnonzero(self.alive)

    def _repair(self, same: np.ndarray) -> None:
        often = np.bincount(self.symbol, minlength=self.terminals) > 1
        at = np.flatnonzero(same[:-1] & often[self.symbol[:-1]] & often[self.symbol[1:]]) if len(same) else \
            np.empty(0, np.int64)
        turn = 0
        while len(at):
            turn += 1
            after = at + self.size[self.symbol[at]]
            a, b = self.symbol[at], self.symbol[after]
            pair, count = _renumber((a << 32) | b)
            # A pair that occurs once stays single however its sides grow.
            more = count[pair] > 1
            at, after, a, b, pair = at[more], after[more], a[more], b[more], pair[more]
            if not len(at):
                return
            follows = np.r_[False, at[1:] == after[:-1]]
            again = follows & np.r_[False, pair[1:] == pair[:-1]]
            streak = np.arange(len(at)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
            usable = streak % 2 == 0  # of a a a only every second pair can go
            count = np.bincount(pair[usable], minlength=len(count))
            rank = np.where(usable & (count[pair] > 1), count[pair], 0)
            before = np.r_[0, np.where(follows[1:], rank[:-1], 0)]
            behind = np.r_[np.where(follows[1:], rank[1:], 0), 0]
            pair_before, pair_behind = np.r_[0, pair[:-1]], np.r_[pair[1:], 0]
            win = (rank > 0) & ((rank > before) | ((rank == before) & (pair < pair_before))) & \
                ((rank > behind) | ((rank == behind) & (pair < pair_behind)))
            chosen = np.bincount(pair[win], minlength=len(count))
            win &= chosen[pair] > 1
            if not win.any():
                return
            rule, _ = _renumber(pair[win])
            new = len(self.size) + rule
            _, head = np.unique(rule, return_index=True)
            wa, wb, wat = a[win], b[win], at[win]
            self.left = np.r_[self.left, wa[head]]
            self.right = np.r_[self.right, wb[head]]
            self.first = np.r_[self.first, wat[head]]
            self.round = np.r_[self.round, np.full(len(head), turn)]
            self.size = np.r_[self.size, self.size[wa[head]] + self.size[wb[head]]]
            self.symbol[wat] = new
            self.alive[after[win]] = False
            # The link inside a new symbol goes; one that began at its right side begins at its left.
            moved = np.r_[False, win[:-1]] & follows
            at = np.where(moved, np.r_[0, at[:-1]], at)[~win]


class Grams:
    """Next and last place of the same words, ``size`` at a time, in powers of two."""

    def __init__(self, words: np.ndarray):
        self.n, self.size = len(words), 1
        self.at = np.arange(self.n)
        self.number = words
        self._link()

    def _link(self) -> None:
        order = np.argsort(self.number, kind="stable")
        same = self.number[order[1:]] == self.number[order[:-1]]
        here, there = self.at[order[:-1]][same], self.at[order[1:]][same]
        self.after = np.zeros(self.n, np.int64)
        self.before = np.zeros(self.n, np.int64)
        self.after[here] = there - here
        self.before[there] = there - here
        repeated = np.zeros(self.n, bool)
        repeated[here] = repeated[there] = True
        keep = repeated[self.at]
        self.at, self.number = self.at[keep], self.number[keep]

    def double(self) -> bool:
        """Twice as many words; False when no such words repeat."""
        whole = np.full(self.n + self.size, -1, np.int64)
        whole[self.at] = self.number
        right = whole[self.at + self.size]
        ok = right >= 0
        self.at = self.at[ok]
        self.number, _ = _renumber((self.number[ok] << 32) | right[ok])
        self.size *= 2
        self._link()
        return len(self.at) > 0

    def distance(self, place: np.ndarray, forward: bool) -> np.ndarray:
        ok = (place >= 0) & (place < self.n)
        found = (self.after if forward else self.before)[np.where(ok, place, 0)] if self.n else place
        return np.where(ok, found, 0)


def _reach(words: np.ndarray, i: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch of period q in low..high around the equal words i, i + q."""
    step, end = 16, i
    while end + q < high:  # first unequal place from i on
        stop = min(end + step, high - q)
        wrong = np.flatnonzero(words[end:stop] != words[end + q:stop + q])
        if len(wrong):
            end += int(wrong[0])
            break
        end, step = stop, step * 4
    step, begin = 16, i
    while begin > low:
        stop = max(begin - step, low)
        wrong = np.flatnonzero(words[stop:begin] != words[stop + q:begin + q])
        if len(wrong):
            begin = stop + int(wrong[-1]) + 1
            break
        begin, step = stop, step * 4
    return begin, end + q


def boundary_runs(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Runs inside low..high that cross the boundary before word ``at``: rows of
    boundary index, start, end, period."""
    # Two runs of one period can cross a boundary (they share less than a period).
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    room = high - low
    which = np.flatnonzero(room >= LEAST_WORDS)
    if not len(which):
        return np.empty((0, 4), np.int64)
    grams = Grams(words)
    while True:
        size = grams.size
        which = which[room[which] >= max(LEAST_WORDS, LEAST_PERIODS * (size // 2 + 1))]
        if not len(which):
            break
        b, half = at[which], size // 2
        for place, forward in ((b, True), (b - half, True), (b - size, False), (b + half - size, False)):
            q = grams.distance(place, forward)
            near = np.flatnonzero((q > half) & (q <= size))
            if not len(near):
                continue
            q, place, who = q[near], place[near], which[near]
            base = place if forward else place - q
            fits = (base >= low[who]) & (base + q + size <= high[who])
            fits &= room[who] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
            for x, i, p in zip(who[fits].tolist(), base[fits].tolist(), q[fits].tolist(), strict=True):
                known = found.setdefault((x, p), [])
                if any(s <= i < e - p for s, e in known):
                    continue
                s, e = _reach(words, i, p, int(low[x]), int(high[x]))
                if e - s >= max(LEAST_WORDS, LEAST_PERIODS * p) and s < at[x] < e:
                    known.append((s, e))
        if not grams.double():
            break
    return np.array([(x, s, e, p) for (x, p), both in found.items() for s, e in both], np.int64).reshape(-1, 4)


def places(grammar: Grammar, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and place of every derivation of a marked nonterminal."""
    t, n = grammar.terminals, len(grammar.size)
    below = np.zeros(n, bool)
    below[t:] = marked
    turns = np.unique(grammar.round)
    for turn in turns:  # rules only use symbols of earlier rounds
        x = np.flatnonzero(grammar.round == turn)
        below[t + x] |= below[grammar.left[x]] | below[grammar.right[x]]
    symbol, place = grammar.symbol[grammar.heads], grammar.heads
    keep = below[symbol]
    symbol, place = symbol[keep], place[keep]
    found = []
    for turn in turns[::-1]:
        now = grammar.round[symbol - t] == turn
        x, p = symbol[now] - t, place[now]
        own = marked[x]
        found.append((symbol[now][own], p[own]))
        left, right = grammar.left[x], grammar.right[x]
        more = np.r_[left, right]
        where = np.r_[p, p + grammar.size[left]]
        keep = below[more]
        symbol, place = np.r_[symbol[~now], more[keep]], np.r_[place[~now], where[keep]]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([s for s, _ in found]), np.concatenate([p for _, p in found])


def find_runs(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows of start, end and period of all runs in documents laid end to end, by
    start and period; ``doc`` is ascending."""
    if not len(words):
        return np.empty((0, 3), np.int64)
    words, _ = _renumber((doc << 32) | words)
    g = Grammar(words, np.r_[doc[1:] == doc[:-1], False])
    n_rules = len(g.left)
    low = g.first
    at = low + g.size[g.left] if n_rules else low
    high = low + g.size[g.terminals:]
    # The start sequence: before its k-th symbol, as far as the lowest set bit of k reaches.
    head_doc = doc[g.heads]
    new = np.r_[True, head_doc[1:] != head_doc[:-1]]
    opening = np.flatnonzero(new)
    part = np.cumsum(new) - 1
    k = np.arange(len(g.heads)) - opening[part]
    inner = np.flatnonzero(k > 0)
    reach = k[inner] & -k[inner]
    ends = np.r_[opening[1:], len(g.heads)][part[inner]]
    edge = np.r_[g.heads, len(words)]
    low = np.r_[low, g.heads[inner - reach]]
    at = np.r_[at, g.heads[inner]]
    high = np.r_[high, edge[np.minimum(inner + reach, ends)]]
    hits = boundary_runs(words, at, low, high)
    own = hits[:, 0] < n_rules
    out = [hits[~own, 1:]]
    if own.any():
        rules = hits[own]
        marked = np.zeros(n_rules, bool)
        marked[rules[:, 0]] = True
        symbol, place = places(g, marked)
        order = np.argsort(symbol, kind="stable")
        symbol, place = symbol[order], place[order]
        lo = np.searchsorted(symbol, rules[:, 0] + g.terminals)
        many = np.searchsorted(symbol, rules[:, 0] + g.terminals, side="right") - lo
        rule = np.repeat(np.arange(len(rules)), many)
        spot = place[lo[rule] + np.arange(len(rule)) - np.repeat(np.cumsum(many) - many, many)]
        shift = spot - g.first[rules[rule, 0]]
        out.append(np.c_[rules[rule, 1] + shift, rules[rule, 2] + shift, rules[rule, 3]])
    runs = np.concatenate(out)
    # Of one period, whatever lies in a longer one goes.
    runs = runs[np.lexsort((-runs[:, 1], runs[:, 0], runs[:, 2]))]
    if len(runs):
        lift = runs[:, 2] * (len(words) + 1)
        top = np.maximum.accumulate(runs[:, 1] + lift)
        fresh = np.r_[True, (runs[1:, 1] + lift[1:] > top[:-1])]
        runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Word numbers of a document after the contract's change; None: unchanged."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    index = np.arange(n)
    index[a:] = a + (index[a:] - a) % p
    return index


_SHAPE = ("doc_id long, n_words long, n_runs long, start long, length long, period long, "
          "exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def _block(ids: list, texts: list[bytes], plant: bool) -> list[tuple]:
    w = Words(texts)
    cut = np.searchsorted(w.text, np.arange(len(texts) + 1))
    index = np.arange(len(w.code))
    changed = set()
    if plant:
        for d, doc_id in enumerate(ids):
            new = planted(int(cut[d + 1] - cut[d]), doc_id)
            if new is not None:
                index[cut[d]:cut[d + 1]] = cut[d] + new
                changed.add(d)
    runs = find_runs(w.code[index], w.text)
    of = w.text[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
    drop = np.zeros(len(index) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 1], -1)
    gone = np.cumsum(drop)[:-1] > 0
    changed.update(np.unique(w.text[gone]).tolist())
    # Kept words with one blank each: the byte after a word becomes that blank.
    marks = np.zeros(len(w.data), bool)
    marks[w.end] = True
    inside = np.cumsum(np.bincount(w.start, minlength=len(w.data) + 1)
                       - np.bincount(w.end, minlength=len(w.data) + 1))[:-1] > 0
    line = w.data.copy()
    line[marks] = 32
    line = line[inside | marks].tobytes()
    size = np.r_[0, np.cumsum(w.end - w.start + 1)]
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for d, doc_id in enumerate(ids):
        a, b = int(cut[d]), int(cut[d + 1])
        if d in changed:
            keep = index[a:b][~gone[a:b]].tolist()
            text = b" ".join([line[size[i]:size[i + 1] - 1] for i in keep])
        else:
            text = line[size[a]:max(size[b] - 1, size[a])]
        mine = runs[first[d]:first[d + 1]]
        listed = [(s - a, e - s, q) for s, e, q in mine.tolist()]
        best = min(listed, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        said = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
        out.append((doc_id, b - a, len(listed), *best, 1000 * best[1] // best[2] if listed else None,
                    hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    return out


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_runs, the longest run (start, length,
    period, exponent_milli) and the hashes of all runs and of the words left when
    each run keeps its first period only. ``plant`` applies the contract's change."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SHAPE.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                rows = _block(ids[a:b], texts[a:b], plant)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, _SHAPE)
