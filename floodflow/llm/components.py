"""Connected components of an edge table, by alternating stars.

Each round rewires every node to the smallest node it sees (large star over
the greater neighbours, small star over the lesser), with grouped minima and
equi-joins only. A round's edges are written as a table; the rounds end when
the edge set no longer changes, after about log(n) of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodflow.llm.base import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        return (edges.join(least, "u").where(F.col("v") > F.col("u"))
                .select(F.col("v").alias("u"), F.col("m").alias("v")))
    hung = edges.join(least, "u").where(F.col("v") != F.col("m"))
    return (hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has u and v, any order, repeats and loops allowed. Returns
    (node, comp) for every node of an edge, comp the smallest node."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    now = (edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    now, mark = materialize(now.distinct(), "edges"), None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _star(both, True).where("u != v").distinct()
        now = materialize(_star(wide, False).where("u != v").distinct(), "edges")
    return (nodes.join(now.withColumnRenamed("u", "node"), "node", "left")
            .select("node", F.coalesce("v", "node").alias("comp")))
