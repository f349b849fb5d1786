"""Weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def uniform_from_key(key: Column, seed: int) -> Column:
    """Deterministic u in (0, 1) from a key and a seed: 53 bits of a seeded hash,
    so nearby keys and nearby seeds draw independently and no id overflows."""
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def weighted_sample(df: DataFrame, key: str, weight: Column | str, k: int, seed: int = 42) -> DataFrame:
    """k rows drawn without replacement, row i with probability proportional
    to its weight at every draw (Efraimidis-Spirakis: the k smallest
    -ln(u)/w). Rows with weight <= 0 or null are never drawn. The k is the
    feature here: Spark keeps k rows per partition and merges them."""
    w = F.col(weight) if isinstance(weight, str) else weight
    u = uniform_from_key(F.col(key), seed)
    return (df.withColumn("_w", w.cast("double"))
              .where(F.col("_w") > 0)
              .withColumn("sample_key", -F.ln(u) / F.col("_w"))
              .orderBy(F.col("sample_key").asc(), F.col(key).asc())
              .limit(k)
              .drop("_w"))
