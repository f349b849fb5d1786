"""The stages of the corpus pipeline, each built on one operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodflow.llm import decontaminate, jaccard_join, line_dedup, packing
from floodflow.llm import quality_rules as rules
from floodflow.llm.base import fresh, materialize, row_key, table

#: Most rows of a broadcast of keys, and most passes over the texts, one for each part of more keys.
BROADCAST_ROWS = 2_000_000
MOST_PARTS = 8


def _few(keys: DataFrame) -> DataFrame:
    """``keys`` (a scratch table): up to a bound they go to the texts, above it the texts to them."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Statistics of the documents whose id is in ``known`` (a scratch table of different ids),
    which is broadcast in parts of bounded size, so that no text is moved."""
    texts, parts = docs.select("doc_id", "text"), max(1, -(-known.count() // BROADCAST_ROWS))
    if parts > MOST_PARTS:
        return materialize(rules.statistics(texts.join(known, "doc_id", "left_semi")).drop("text"), "rules-stats")
    out = []
    for part in range(parts):
        mine = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part)
        stats = rules.statistics(texts.join(F.broadcast(mine), "doc_id", "left_semi")).drop("text")
        out.append(materialize(stats, "rules-stats"))
    return reduce(DataFrame.unionByName, out)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject. The list
    is learned from the labelled documents of the stage's input. Null, empty and blank
    texts fail the base rules; rows that repeat share their fate; no labels, no list."""
    labels = table(spark, sf_dir, "labels")
    known = materialize(labels.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "rules-known")
    found = rules.learn(_labelled(docs, known), labels)
    kept = rules.apply(rules.statistics(docs.select("text", F.struct("*").alias("_doc"))), found)
    return kept.where("kept").select("_doc.*")


def line_dedup_stage(docs: DataFrame) -> DataFrame:
    out = line_dedup.dedup_lines(docs, min_words=1)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~emptied).withColumn("n_chars", F.length("text").cast("long"))


def line_dedup_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one; a document of which no word
    is left goes. Null and empty texts have no lines and stay; of equal lines the one
    with the smallest id, then place, stays; rows that repeat stay equal."""
    return line_dedup_stage(docs).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents (shingles of five words, a
    similarity of 0.8; op5's values are its own contract): the one with the smallest
    id, no id before all others, and among texts of one id the one with the smallest
    row key. Rows that repeat it are one document."""
    found = jaccard_join.join_components(docs.select("doc_id", "text"), size=5, percent=80)
    # Rows of one key are one text. Most texts stay where they are: only the keys of those that go
    # or that several rows have are looked up.
    found = found.groupBy("rk").agg(F.count("*").alias("k"), F.min("first").alias("first"))
    odd = found.where("k > 1 OR rk != first").select("rk", F.col("rk").eqNullSafe(F.col("first")).alias("stays"))
    odd = materialize(odd, "near-odd")
    own = fresh(docs, "_rk")
    rows = docs.withColumn(own, row_key("doc_id", "text"))
    if odd.count() > BROADCAST_ROWS:
        gone = odd.where("NOT stays")
        return rows.join(gone, rows[own] == gone["rk"], "left_anti").dropDuplicates([own]).drop(own)
    keys, again = F.broadcast(odd), F.broadcast(odd.where("stays"))
    alone = rows.join(keys, rows[own] == keys["rk"], "left_anti")
    again = rows.join(again, rows[own] == again["rk"], "left_semi").dropDuplicates([own])
    return alone.unionByName(again).drop(own)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule does not call contaminated. Null and empty
    texts have no words and stay; rows that repeat share their fate."""
    found = decontaminate.judge(docs, table(spark, sf_dir, "benchmark"))
    bad = _few(materialize(found.where("contaminated").select("rk").distinct(), "contaminated"))
    own = fresh(docs, "_rk")
    rows = docs.withColumn(own, row_key("doc_id", "text"))
    return rows.join(bad, rows[own] == bad["rk"], "left_anti").drop(own)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset; ``ids`` are little-endian uint32. A null
    or empty text is the end id alone; rows that repeat are packed each."""
    return packing.pack(materialize(packing.pieces(docs), "pack-pieces"))
