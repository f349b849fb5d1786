"""Shared helpers of the training-data operators.

Rows are told apart by ``row_key``, a 64-bit hash of document id and text that
is never null: rows that repeat both get the same result, rows that share only
the id are kept apart, and a null id or text needs no special join.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodflow.sources import files
from floodflow.sources.files import shared_dir  # noqa: F401 - re-exported

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_BREAK = r"[\x20\x09-\x0D]+"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_READ = "spark.sql.parquet.columnarReaderBatchSize"
#: Parquet's writer looks at the size of a page, and of a row group, after a hundred rows
#: unless told otherwise, and its codec keeps a whole page outside the heap.
_LARGE = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def materialize(df: DataFrame, name: str = "stage", batch_bytes: int | None = None,
                read_rows: int | None = None) -> DataFrame:
    """``files.materialize``; Spark removes the shuffle files of the write as soon as it is
    done, instead of when the driver next collects its garbage. For tables of large rows,
    ``batch_bytes``: size from which an Arrow batch takes no further row (pages are short then);
    ``read_rows``: rows that the Parquet reader holds at once."""
    conf = df.sparkSession.conf
    wanted = {_CLEANUP: "true"} | {k: str(v) for k, v in ((_BATCH, batch_bytes), (_READ, read_rows)) if v is not None}
    before = {k: conf.get(k) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        return files.materialize(df, name, None if batch_bytes is None else _LARGE)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str) -> Column:
    """Never-null 64-bit key of a row; nulls and values hash differently."""
    parts = []
    for c in cols:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the cheaper built-in."""
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())))


def split_words(text: Column, pattern: str = WORD_BREAK) -> Column:
    """Words between breaks; null or blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), pattern), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or as many underscores after it as keep it from clashing with a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Have the driver forget frames that are out of use, so that Spark's cleaner removes
    their shuffle files; otherwise they stay until the driver next needs memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove the scratch table that ``materialize`` returned as ``df``: its last reader
    is done. Nothing else may still be computed from it."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/floodflow-" not in folder:
            raise ValueError("not a scratch table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
