"""Benchmark decontamination: prefix-filtered exact containment join.

An item window (``WINDOW`` consecutive words; the whole item when it is
shorter) occurs in a document when all its word shingles do, in order. Full
containment leaves a prefix of one shingle, so the join takes only the rarest
shingle of each window, by its count over all documents: a window whose rarest
shingle is absent cannot occur. The shingle's place in the window gives the one
alignment to test (positional bound), the document's length cuts alignments
that stick out (length bound), and the words themselves decide.

The benchmark side is broadcast only while it counts at most
``broadcast_rows`` window shingles; beyond, the same joins shuffle, carrying
the few words around each shingle instead of the text.

Defined cases: a null or wordless text has no words and no hits; null or
wordless items have no windows; a null item id counts as an item and is
written as the empty string; rows that repeat id and text get equal rows, and
items that repeat an id count once. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodflow.llm.base import lower_ascii, materialize, row_key, split_words

WINDOW = 13
SHINGLE = 3
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(F.coalesce(text, F.lit(""))), _BREAK)


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, by position from 0."""
    n = F.size(words)
    h = F.transform(words, lambda a: F.xxhash64(F.lit(size), a))
    for i in range(2, size + 1):
        h = F.zip_with(h, F.slice(words, i, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    return F.when(n >= size, F.slice(h, 1, F.greatest(n - (size - 1), F.lit(1))))


def windows(items: DataFrame) -> DataFrame:
    """Distinct windows: ``words``, ``len``, ``win`` and the sorted item ids."""
    w = (items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                      words_of(F.col("text")).alias("w")).where(F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    w = w.select("item", F.explode(F.transform(
        starts, lambda i: F.slice(F.col("w"), i, WINDOW))).alias("words"))
    return (w.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
            .select("words", "items", F.size("words").alias("len"), F.xxhash64("words").alias("win")))


def _window_shingles(wins: DataFrame, size: int) -> DataFrame:
    own = wins.where(F.col("len") >= SHINGLE) if size == SHINGLE else wins.where(F.col("len") == size)
    return own.select("words", "items", "len", F.posexplode(_shingles(F.col("words"), size)).alias("off", "h"))


def hits(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Windows that occur: one row per document key ``rk`` with the sorted array
    ``spans`` of (start, end) word ranges and the sorted ids of the items."""
    wins = materialize(windows(items), "bench-windows")
    lens = [r["len"] for r in wins.select("len").distinct().where(F.col("len") <= SHINGLE).collect()]
    sizes = sorted({min(n, SHINGLE) for n in lens} | {SHINGLE})
    keys = _window_shingles(wins, SHINGLE)
    for s in sizes[:-1]:
        keys = keys.unionByName(_window_shingles(wins, s))
    keys = materialize(keys, "bench-shingles")
    small = keys.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)

    base = docs.select(row_key("doc_id", "text").alias("rk"), words_of(F.col("text")).alias("w"))

    def spots(size: int, with_words: bool) -> DataFrame:
        more = ["w"] if with_words else []
        out = base.select("rk", *more, F.posexplode(_shingles(F.col("w"), size)).alias("pos", "h"))
        if with_words and not small:  # carry what a window can reach, not the text
            out = out.select("rk", "pos", "h", F.slice(
                "w", F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0)) + 1, 2 * WINDOW).alias("near"))
        return out

    def all_spots(with_words: bool) -> DataFrame:
        out = spots(sizes[-1], with_words)
        for s in sizes[:-1]:
            out = out.unionByName(spots(s, with_words))
        return out

    # rarity of the benchmark's shingles over all documents
    counts = (all_spots(False).join(hint(keys.select("h").distinct()), "h", "left_semi")
              .groupBy("h").agg(F.count("*").alias("freq")))
    ranked = keys.join(hint(counts) if small else counts, "h")  # absent shingle: window cannot occur
    prefix = (ranked.groupBy("words")
              .agg(F.min(F.struct("freq", "h", "off")).alias("k"), F.count("*").alias("present"),
                   F.first("len").alias("len"), F.first("items").alias("items"))
              .where(F.col("present") == F.greatest(F.col("len") - (SHINGLE - 1), F.lit(1)))
              .groupBy(F.col("k.h").alias("h"))
              .agg(F.collect_list(F.struct(F.col("k.off").alias("off"), "len", "words", "items")).alias("wins")))
    prefix = materialize(prefix, "bench-prefix")

    found = all_spots(True).join(hint(prefix), "h")
    if small:
        at = lambda x: F.slice(F.col("w"), F.col("pos") - x["off"] + 1, x["len"])
    else:
        first = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0))
        at = lambda x: F.slice(F.col("near"), F.col("pos") - x["off"] - first + 1, x["len"])
    matched = F.filter("wins", lambda x: (F.col("pos") >= x["off"])
                       & F.when(F.col("pos") >= x["off"], at(x) == x["words"]).otherwise(False))
    found = (found.select("rk", "pos", matched.alias("m")).where(F.size("m") > 0)
             .select("rk", F.transform("m", lambda x: F.struct(
                 (F.col("pos") - x["off"]).alias("start"),
                 (F.col("pos") - x["off"] + x["len"]).alias("end"))).alias("spans"),
                 F.flatten(F.transform("m", lambda x: x["items"])).alias("items")))
    return (found.groupBy("rk").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("items"))))).alias("items")))


def _covered(spans: Column) -> Column:
    """Words under a sorted array of spans."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["sum"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("sum")),
        lambda a: a["sum"])


def judge(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs``: rk, doc_id, n_words, n_hit, spans, items, contaminated."""
    found = hits(docs, items, broadcast_rows)
    sizes = docs.select(row_key("doc_id", "text").alias("rk"), "doc_id",
                        F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = sizes.join(found, "rk", "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return out.select(
        "rk", "doc_id", "n_words", n_hit.alias("n_hit"), "spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
