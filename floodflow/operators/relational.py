"""Small relational building blocks used by the plans."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size up to which a table is broadcast; measured before each use.
BROADCAST_BYTES = 64 << 20


def split(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where cond is true, rows where cond is false). Rows whose
    condition is null are in neither part (three-valued logic).

    Keep the columns that ``cond`` reads in ``df``: both parts are plain
    filters over the same parent, so a cache of the parent serves both."""
    return df.filter(cond), df.filter(~cond)


def select_distinct(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def argmin_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows at the minimum of ``value`` within each ``key``; ties all kept.
    Rows with a null key or a null value never qualify.

    Written as rank() == 1 over a window: Spark plans a partial
    WindowGroupLimit before the shuffle, so only candidates move."""
    w = Window.partitionBy(key).orderBy(F.col(value).asc())
    return (df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
              .withColumn("_rk", F.rank().over(w))
              .where(F.col("_rk") == 1)
              .drop("_rk"))


def fill_nulls(df: DataFrame, number=0, text: str | None = "Waterworld",
               text_subset: list[str] | None = None) -> DataFrame:
    """Nulls in numeric columns become ``number``; nulls in string columns
    become ``text`` (all string columns unless ``text_subset`` is given)."""
    out = df.na.fill(number)
    if text is not None:
        out = out.na.fill(text, subset=text_subset) if text_subset else out.na.fill(text)
    return out


def byte_size(df: DataFrame) -> int:
    """Bytes of all rows as JSON text, a measure that long texts and arrays count in."""
    if not df.columns:
        return 0
    return int(df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES, size: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its size (measured unless given) is within
    ``limit``; otherwise as it is, and Spark shuffles or splits the join."""
    return F.broadcast(df) if (byte_size(df) if size is None else size) <= limit else df


@contextlib.contextmanager
def cached(*dfs: DataFrame):
    """Cache frames that several actions share and always release them."""
    for d in dfs:
        d.cache()
    try:
        yield dfs if len(dfs) > 1 else dfs[0]
    finally:
        for d in dfs:
            d.unpersist()
