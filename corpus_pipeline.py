"""Corpus pipeline: the stages that turn raw documents into packed sequences.

Every stage takes ``(spark, docs, sf_dir)``; ``run`` writes its result as
Parquet into the cluster's shared folder and hands the table to the next one.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from floodflow.llm import pipeline_stages as stages
from floodflow.llm.base import materialize, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup_rows),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("best_fit_packing", stages.best_fit_packing),
]

#: The rules are learned and the tokens come from a tokenizer file, which SQL
#: cannot express. The tests compare the operators with brute force and check
#: the stages' columns, rows and groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
