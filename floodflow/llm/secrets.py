"""Secret scans: pattern candidates, filtered by a random forest.

Candidates are values of eight characters and more assigned to credential names,
and runs of sixteen token characters and more, each of them whole: neither has an
upper length, and letters alone will do.
A forest tells secrets from false positives by length, character transitions
(mean log probability of character pairs under the corpus dictionary), share of
characters covered by dictionary words, absence of digits, path-like context and
neighbouring words. It learns from labelled findings; ``seed_findings`` makes them from rules
that leave no doubt either way, for corpora without any.

The dictionary holds the ``DICTIONARY`` most frequent words by counts over all
documents; it and the forest have fixed sizes and travel by broadcast.

Defined cases: null and empty texts have no candidates; a null path is empty;
without both classes among the findings every candidate scores the share of
label 1 (0.5 without findings); rows that repeat give equal findings each.
Offsets are code points. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodflow.llm.base import materialize, split_words

DICTIONARY = 5000
MAX_TRAIN_ROWS = 20_000
NEIGHBOURS = 3
LEAST_RUN = 16
_BUCKETS = 8
_ASSIGNED = re.compile(
    r"(?i)(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*+[=:]\s*+[\"']?([^\s\"',;]{8,}+)")
_TOKEN = re.compile(rf"[A-Za-z0-9_\-+/=]{{{LEAST_RUN},}}+")
_VENDOR = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{32,}")
_PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|placeholder|change|your|xxxx|0000|1234|test")
_CREDENTIAL = re.compile(r"(?i)password|passwd|secret|token|key|credential|auth")
FEATURES = ("length", "entropy", "transitions", "coverage", "digits", "upper", "lower", "marks", "changes",
            "longest_run", "hex", "slashes", "path_depth", "path_test", "assigned", "credential_near",
            "no_digit", "joined_before", "joined_after",
            *(f"near{i}" for i in range(_BUCKETS)))


def dictionary(docs: DataFrame) -> list[str]:
    rows = (docs.select(F.explode(split_words(F.lower("text"))).alias("w"))
            .where(F.col("w").rlike(r"^\p{L}{2,30}$")).groupBy("w").agg(F.count("*").alias("c"))
            .orderBy(F.desc("c"), "w").limit(DICTIONARY).collect())
    return [r["w"] for r in rows]


def candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, assigned) of the candidates, without overlaps.

    Token characters are value characters too, so a run that meets a value ends
    with or in it; what stands before the value's name is a run of its own.
    """
    taken = [(m.start(), m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text)]
    k = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][2] <= a:
            k += 1
        if k < len(taken) and taken[k][1] < b:
            b = taken[k][0]
        if b - a >= LEAST_RUN:
            yield a, b, False
    for _, a, b in taken:
        yield a, b, True


class Describer:
    """Turns a candidate and its surroundings into the features."""

    def __init__(self, words: list[str]):
        self.words = {w for w in words if len(w) >= 3}
        self.most = max(map(len, self.words), default=0)
        pairs = np.ones((128, 128))
        for w in words:
            codes = [min(ord(c), 127) for c in f" {w} "]
            for a, b in zip(codes, codes[1:], strict=False):
                pairs[a, b] += 1
        self.log = np.log(pairs / pairs.sum(1, keepdims=True))

    def coverage(self, s: str) -> float:
        """Share of characters that greedy longest dictionary matches cover."""
        s, at, got = s.lower(), 0, 0
        while at < len(s):
            for n in range(min(self.most, len(s) - at), 2, -1):
                if s[at:at + n] in self.words:
                    got += n
                    at += n
                    break
            else:
                at += 1
        return got / max(len(s), 1)

    def __call__(self, s: str, before: str, after: str, path: str, assigned: bool) -> list[float]:
        n = len(s)
        codes = [min(ord(c), 127) for c in s]
        counts = np.bincount(codes)
        share = counts[counts > 0] / n
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in s]
        run = most = 1
        for a, b in zip(s, s[1:], strict=False):
            run = run + 1 if a == b else 1
            most = max(most, run)
        near = [0.0] * _BUCKETS
        for w in before.split()[-NEIGHBOURS:] + after.split()[:NEIGHBOURS]:
            near[sum(w.lower().encode()) % _BUCKETS] += 1.0
        return [
            float(n), float(-(share * np.log2(share)).sum()),
            float(np.mean(self.log[codes[:-1], codes[1:]])) if n > 1 else 0.0, self.coverage(s),
            kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("m") / n,
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, float(most),
            sum(c in "0123456789abcdefABCDEF" for c in s) / n, float(s.count("/")), float(path.count("/")),
            float(bool(re.search(r"(?i)test|example|sample|doc", path))), float(assigned),
            float(bool(_CREDENTIAL.search(before[-40:]))), float("d" not in kinds),
            float(before.endswith((".", "@"))), float(after.startswith("@")), *near]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left, right, value."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    base: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.base)
        out = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                f = feature[at[i]]
                at[i] = np.where(x[i, f] <= cut[at[i]], left[at[i]], right[at[i]])
            out += value[at]
        return out / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 8, least: int = 3, bins: int = 24,
         seed: int = 11) -> Forest:
    """Bagged trees; each split tries a random third of the features on quantile cuts."""
    if len(np.unique(y)) < 2:
        return Forest(base=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    some = max(1, x.shape[1] // 3)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        nodes: list[list] = []
        todo = [(rows, 0, -1, 0)]
        while todo:
            own, level, parent, side = todo.pop()
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, float(y[own].mean())])
            if parent >= 0:
                nodes[parent][2 + side] = me
            if level == depth or len(own) < 2 * least or len(np.unique(y[own])) < 2:
                continue
            best = (1e-9, -1, 0)
            total, ones = len(own), y[own].sum()
            pure = (ones ** 2 + (total - ones) ** 2) / total
            for f in rng.choice(x.shape[1], some, replace=False):
                if not len(cuts[f]):
                    continue
                n = np.cumsum(np.bincount(binned[own, f], minlength=len(cuts[f]) + 1))[:-1]
                p = np.cumsum(np.bincount(binned[own, f], y[own], len(cuts[f]) + 1))[:-1]
                ok = (n >= least) & (total - n >= least)
                if ok.any():
                    m, q = total - n, ones - p
                    gain = np.where(ok, (p ** 2 + (n - p) ** 2) / np.maximum(n, 1)
                                    + (q ** 2 + (m - q) ** 2) / np.maximum(m, 1) - pure, 0)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (float(gain[j]), int(f), j)
            if best[1] < 0:
                continue
            nodes[me][:2] = [best[1], float(cuts[best[1]][best[2]])]
            go = binned[own, best[1]] <= best[2]
            todo += [(own[go], level + 1, me, 0), (own[~go], level + 1, me, 1)]
        cols = list(zip(*nodes, strict=True))
        out.append((np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4])))
    return Forest(out)


_FOUND = ("doc_id long, start int, end int, candidate string, before string, after string, path string, "
          "assigned boolean, x binary")


def find(docs: DataFrame, words: list[str], path: str | None = "source") -> DataFrame:
    """Candidates of every text with their surroundings and features ``x``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = None
        for batch in it:
            describe = describe or Describer(shared.value)
            rows = []
            for doc, text, place in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path")),
                                        strict=True):
                for a, b, assigned in candidates(text or ""):
                    s, before, after = text[a:b], text[max(0, a - 80):a], text[b:b + 80]
                    x = np.array(describe(s, before, after, place, assigned), "<f8")
                    rows.append((doc, a, b, s, before, after, place, assigned, x.tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int32(), *(pa.string(),) * 4, pa.bool_(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "start", "end", "candidate", "before", "after", "path", "assigned", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", where.alias("path")).mapInArrow(run, _FOUND)


def seed_findings(found: DataFrame) -> DataFrame:
    """Findings that rules settle: ``x`` and ``label``.

    1: a vendor's key format, or a value of hexadecimal or mixed characters with
    digits assigned to a credential name; 0: placeholders, one character repeated,
    and candidates that are mostly words or numbers. The rest is left open, values
    of letters alone included: a password may be a word.
    """
    c = F.col("candidate")
    hold = c.rlike(_PLACEHOLDER.pattern) | c.rlike(r"(.)\1{7,}")
    vendor = c.rlike(f"^({_VENDOR.pattern})$")
    digit = c.rlike("[0-9]")
    value = F.col("assigned") & digit & (c.rlike(r"^[0-9a-f]{16,}$") | (c.rlike("[A-Z]") & c.rlike("[a-z]")))
    # possessive, since Java's matcher recurses at every turn of a group it may give back
    words = F.when(digit, c.rlike(r"^[A-Za-z]++(?:[-_/][A-Za-z]++)*+[-_/]?[0-9]{0,4}$")).otherwise(
        ~F.col("assigned") & c.rlike(r"^(?:[-_/]*+(?:[A-Z]?[a-z]++|[A-Z]++))(?:[-_/]++(?:[A-Z]?[a-z]++|[A-Z]++))*+[-_/]*+$"))
    plain = c.rlike(r"^[0-9.+/=_-]+$") | words
    label = F.when(hold | (plain & ~vendor), 0).when(vendor | value, 1)
    return found.select("x", label.alias("label")).where(F.col("label").isNotNull())


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str | None = "source",
         threshold: float = 0.5, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """All candidates with ``score`` and ``secret``. ``findings`` (x, label) are
    labelled candidates as ``find`` describes them; by default the seeds."""
    found = materialize(find(docs, dictionary(docs), path), "secret-candidates")
    taught = (seed_findings(found) if findings is None else findings).where(F.col("label").isin(0, 1))
    sample = taught.orderBy(F.xxhash64("x", F.lit(5)), "x", "label").limit(max_train_rows).toArrow()
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), "<f8").reshape(-1, len(FEATURES))
    forest = grow(x, np.array(sample.column("label").to_pylist(), np.float64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            z = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<f8").reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(forest.score(z), pa.float64())],
                names=[*names, "score"])

    names = ["doc_id", "start", "end", "candidate", "path", "assigned"]
    out = found.mapInArrow(run, "doc_id long, start int, end int, candidate string, path string, "
                                "assigned boolean, score double")
    return out.withColumn("secret", F.col("score") >= F.lit(threshold))

