"""Quality rules: learned decision lists over per-document statistics.

Sequential covering on Spark histograms. Statistics of labelled documents are
binned once at quantile thresholds; every growing step is one aggregation that
counts both classes per (statistic, bin) among the rows the rule still covers,
so the driver only sees histograms whose size is fixed by the parameters.
A grown conjunction is pruned from its end on rows held back for pruning, and
accepted only while its precision there stays above ``min_precision``. The
list is emitted as one ordered ``when`` expression.

Defined cases: a null or blank text has no words, so the base rules reject it;
labels that are null, or of unknown documents, are left out; a document with
several labels counts with its smallest; without usable labels the list is
empty and only the base rules decide. Repeated rows each keep their own row;
other columns are passed on untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodflow.llm.base import fresh, let, materialize, split_words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Ratios that the decision list may test.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share",
            "upper_share", "mark_share", "digit_share", "distinct_share", "words_per_line")


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more in the text.

    Most texts repeat no window, which a distinct count of the window hashes
    tells. Else the hashes are sorted with their positions, a window repeats
    when a neighbour has its hash, and the covered words are the union of the
    repeated windows' spans.
    """
    def spans(h: Column) -> Column:
        s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return let(s, repeated)

    def repeated(s: Column) -> Column:
        n = F.size(s)
        twin = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1),
                          lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
        spots = F.sort_array(F.flatten(F.filter(twin, lambda p: p.isNotNull())))
        return F.aggregate(
            spots, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")),
            lambda a, p: F.struct(
                (p + WINDOW).alias("end"),
                (a["sum"] + p + WINDOW - F.greatest(a["end"], p)).alias("sum")),
            lambda a: a["sum"])

    def chained(h: Column) -> Column:
        n, z = F.size(h), h
        for i in range(2, WINDOW + 1):
            z = F.zip_with(z, F.slice(h, i, n), lambda a, b: F.xxhash64(a, b))
        return F.slice(z, 1, n - (WINDOW - 1))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), chained)
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), spans(h))
                .otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, the ratios and ``base_failed`` added.

    Names that ``docs`` already uses are replaced. The counts come out of a
    generator, which keeps later filters from computing them again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    by_word = let(split_words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).alias("types")))
    by_line = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                  lambda x: F.struct(F.size(x).alias("lines"),
                                     F.size(F.array_distinct(x)).alias("distinct")))
    counts = F.struct(
        by_word.alias("w"), by_line.alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("symbols"),
        F.regexp_count(text, F.lit(r"[A-ZÀ-ÖØ-Þ]")).alias("upper"),
        F.regexp_count(text, F.lit(r"[!?]")).alias("marks"),
        F.regexp_count(text, F.lit(r"[0-9]")).alias("digits"))
    own = fresh(docs, "_s")
    df = docs.select("*", F.explode(F.array(counts)).alias(own))
    df = df.withColumns({
        "n_words": F.col(f"{own}.w.n_words"),
        "word_chars": F.col(f"{own}.w.word_chars"),
        "n_symbols": F.col(f"{own}.symbols"),
        "n_dup_lines": (F.col(f"{own}.l.lines") - F.col(f"{own}.l.distinct")).cast("long"),
        "n_repeat_words": F.col(f"{own}.w.n_repeat_words"),
    })

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).cast("double")

    return df.withColumns({
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", f"{own}.l.lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share(f"{own}.upper", "word_chars"),
        "mark_share": share(f"{own}.marks", "word_chars"),
        "digit_share": share(f"{own}.digits", "word_chars"),
        "distinct_share": share(f"{own}.w.types", "n_words"),
        "words_per_line": share("n_words", f"{own}.l.lines"),
        "base_failed": ((F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))),
    }).drop(own)


@dataclass
class Rule:
    """A conjunction of ``(statistic, op, threshold)`` that rejects."""

    terms: list[tuple[str, str, float]]
    covered: tuple[int, int] = (0, 0)

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.terms:
            c = F.col(name)
            out = out & ((c <= F.lit(at)) if op == "<=" else (c > F.lit(at)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {t:.6g}" for n, op, t in self.terms)


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, none keeps."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """Number of the first rule that holds, from 1; null keeps."""
        out = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(rule.column(), F.lit(i)).otherwise(out)
        return out


def _below(name: str) -> Callable[[Column], Column]:
    return lambda t: t < F.col(name)


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Quantiles of both classes per statistic, a list of fixed length at most."""
    at = [i / bins for i in range(1, bins)]
    got = rows.groupBy("y").agg(*[F.percentile_approx(f, at, 10000).alias(f) for f in FEATURES])
    out: dict[str, set[float]] = {f: set() for f in FEATURES}
    for r in got.collect():
        for f in FEATURES:
            out[f].update(r[f] or [])
    return {f: sorted(v) for f, v in out.items()}


def learn(stats: DataFrame, labels: DataFrame, *, label: str = "quality", bins: int = 24,
          max_rules: int = 12, max_terms: int = 3, min_cover: int = 8,
          min_precision: float = 0.9) -> DecisionList:
    """Learn a list that rejects documents labelled 0 and passes those labelled 1.

    ``stats`` has ``doc_id``, the statistics and ``base_failed``; documents the
    base rules reject teach nothing. All labelled documents are used.
    """
    y = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
         .groupBy("doc_id").agg(F.min(label).alias("y")))
    rows = (stats.where(~F.col("base_failed")).select("doc_id", *FEATURES).join(y, "doc_id")
            .select((F.col("y") == 0).cast("int").alias("y"),
                    (F.crc32(F.concat(F.lit("prune"), F.col("doc_id").cast("string"))) % 3 == 0)
                    .alias("held"), *FEATURES))
    rows = materialize(rows, "rules-labelled")
    cuts = _thresholds(rows, bins)
    binned = rows
    for f in FEATURES:
        edges = F.array(*[F.lit(float(t)) for t in cuts[f]]) if cuts[f] else F.array().cast("array<double>")
        binned = binned.withColumn(f"b_{f}", F.size(F.filter(edges, _below(f))))
    binned = materialize(binned, "rules-binned")

    found = DecisionList()
    left = binned
    for _ in range(max_rules):
        rule = _grow(left.where(~F.col("held")), cuts, max_terms)
        if not rule:
            break
        rule = _prune(left.where(F.col("held")), rule)
        if rule is None or rule.covered[0] < min_cover / 3 or \
                rule.covered[0] < min_precision * sum(rule.covered):
            break
        found.rules.append(rule)
        left = left.where(~rule.column())
    return found


def _grow(rows: DataFrame, cuts: dict[str, list[float]], max_terms: int) -> list | None:
    terms: list[tuple[str, str, float]] = []
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b_{f}").alias("b"))
                                for i, f in enumerate(FEATURES)])).alias("c")
    while len(terms) < max_terms:
        hist = (rows.where(Rule(terms).column()).select("y", cells)
                .groupBy("c.f", "c.b").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect())
        per: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
        for r in hist:
            per[FEATURES[r["f"]]][r["b"]] = (r["p"], r["n"] - r["p"])
        p0 = sum(p for p, _ in per[FEATURES[0]].values())
        n0 = sum(n for _, n in per[FEATURES[0]].values())
        if not p0 or not n0:
            break
        best = (1e-9, "", "", 0.0)
        base = math.log2(p0 / (p0 + n0))
        for f in FEATURES:
            p = n = 0
            for b, t in enumerate(cuts[f]):  # bin b holds the values up to threshold b
                dp, dn = per[f].get(b, (0, 0))
                p, n = p + dp, n + dn
                for op, a, c in (("<=", p, n), (">", p0 - p, n0 - n)):
                    if a and (a, c) != (p0, n0):
                        gain = a * (math.log2(a / (a + c)) - base)
                        if gain > best[0]:
                            best = (gain, f, op, t)
        if not best[1]:
            break
        terms.append(best[1:])
    return terms or None


def _prune(held: DataFrame, terms: list) -> Rule | None:
    """The prefix of the conjunction with the best (p - n) / (p + n) on held rows."""
    heads = [Rule(terms[:i]) for i in range(1, len(terms) + 1)]
    r = held.agg(*[F.sum(h.column().cast("int") * v).alias(f"{k}{i}") for i, h in enumerate(heads)
                   for k, v in (("p", F.col("y")), ("n", 1 - F.col("y")))]).first()
    best = None
    for i, h in enumerate(heads):
        p, n = r[f"p{i}"] or 0, r[f"n{i}"] or 0
        if p + n and (best is None or (p - n) / (p + n) > best[0]):
            best = ((p - n) / (p + n), Rule(h.terms, (p, n)))
    return best[1] if best else None


def apply(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds ``rule`` (number of the rejecting rule) and ``kept``."""
    return (stats.withColumn("rule", F.when(~F.col("base_failed"), rules.verdict()))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))


def judge(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Statistics, verdicts and all columns of ``docs`` but the text."""
    stats = materialize(statistics(docs).drop("text"), "rules-stats")
    return apply(stats, learn(stats, labels, **params))
