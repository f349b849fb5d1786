"""File scans and sinks with declared schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from floodflow import schemas


def read_orc(spark: SparkSession, path: str | list[str], schema: StructType,
             ignore_corrupt: bool = False) -> DataFrame:
    """ORC scan with a declared schema; globs allowed. Corrupt files fail the
    read; ``ignore_corrupt`` skips them for this read only (not through a
    global setting), which loses their rows. ORC predicate pushdown is on by
    default."""
    paths = [path] if isinstance(path, str) else list(path)
    return (spark.read.schema(schema)
            .option("ignoreCorruptFiles", str(ignore_corrupt).lower())
            .orc(*paths))


def read_parquet(spark: SparkSession, path: str | list[str], schema: StructType,
                 ignore_corrupt: bool = False) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return (spark.read.schema(schema)
            .option("ignoreCorruptFiles", str(ignore_corrupt).lower())
            .parquet(*paths))


def unread_files(spark: SparkSession, path: str | list[str], schema: StructType, kind: str = "parquet") -> DataFrame:
    """(path, length) of the files that a read with ``ignore_corrupt`` gives no row of:
    the corrupt ones, and valid files without rows. Both sides are distributed: the
    listing of the folder, and the paths seen while reading."""
    paths = [path] if isinstance(path, str) else list(path)
    there = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"*.{kind}").load(paths).select("path", "length"))
    rows = (read_parquet if kind == "parquet" else read_orc)(spark, paths, schema, ignore_corrupt=True)
    read = rows.select(F.col("_metadata.file_path").alias("path")).distinct()
    same = F.regexp_replace(there["path"], "^file:/+", "/") == F.regexp_replace(read["path"], "^file:/+", "/")
    return there.join(read, same, "left_anti")


def read_nodes(spark: SparkSession, path) -> DataFrame:
    return read_orc(spark, path, schemas.NODES).to(schemas.NODES)


def read_elevation(spark: SparkSession, path) -> DataFrame:
    return read_parquet(spark, path, schemas.ELEVATION).to(schemas.ELEVATION)


def write_orc(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """ORC sink. Default mode fails when the target exists, as the
    reference's default save does."""
    df.write.mode(mode).orc(path)


def run_key() -> str:
    """Collision-free key for a per-run output folder."""
    return uuid.uuid4().hex


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    from floodflow.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/floodflow-{name}-{run_key()}"


def materialize(df: DataFrame, name: str = "stage", options: dict[str, str] | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table in the shared
    checkpoint folder and reading it back (columnar and compressed; cheaper
    than a row-serialised RDD checkpoint for wide intermediate tables).
    ``options``: of the writer."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("errorifexists").options(**options or {}).parquet(path)
    return df.sparkSession.read.parquet(path)
