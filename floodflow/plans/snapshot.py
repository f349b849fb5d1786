"""Map side: enrich the update stream with the city table and keep the
latest state per city for a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodflow.functions.columns import change_ratio, map_style
from floodflow.operators.relational import BROADCAST_BYTES, byte_size


def enrich_updates(updates: DataFrame, cities: DataFrame, key: str = "city_id",
                   broadcast_bytes: int = BROADCAST_BYTES, cities_bytes: int | None = None) -> DataFrame:
    """Left lookup of each decoded update in the city table. An update without
    an id or with an unknown id keeps its row with a null feature.

    Adds ``count`` (= refugees), keeps ``change``, and adds ``feature`` (the
    city's struct, or null). The city table is broadcast when its measured size
    (or ``cities_bytes``, if known) allows it, also for a streaming left side."""
    more = [c for c in ("feature_text",) if c in cities.columns]
    dim = cities.select(F.col("city_id").alias("_fid"), "feature", *more)
    size = byte_size(dim) if cities_bytes is None else cities_bytes
    # Beyond the bound each task hashes its share of the cities (one row each); the
    # updates, many for a city, are not sorted.
    dim = F.broadcast(dim) if size <= broadcast_bytes else dim.hint("shuffle_hash")
    return (updates.join(dim, updates[key] == dim["_fid"], "left")
            .drop("_fid")
            .withColumnRenamed("refugees", "count"))


def latest_per_key(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the value of the latest row per key."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def latest_non_null(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the value of the latest row per key where it is not
    null; null when the key never had one."""
    o = F.when(F.col(value).isNotNull(), F.struct(*order))
    return df.groupBy(key).agg(F.max_by(F.col(value), o).alias(value))


def latest_state(enriched: DataFrame, order: list[str], key: str = "city_id") -> DataFrame:
    """(key, name, count, change) per city with a feature: latest count and
    latest non-null change."""
    f = (enriched.where(F.col("feature").isNotNull())
         .withColumn("_k", F.col("feature.properties.geoname_id").cast("long"))
         .withColumn("_name", F.col("feature.properties.name")))
    if len(order) > 1:
        f = f.withColumn("_o", F.struct(*order))
        nulls = F.lit(False)
    else:
        f = f.withColumn("_o", F.col(order[0]))
        nulls = F.max("_o").isNull()
    known = F.when(F.col("change").isNotNull(), F.col("_o"))
    # First by name as well: with one order column all buffers have a fixed width, so the
    # updates are hashed where they are instead of sorted, and a row a city and name moves.
    rows = f.groupBy("_k", "_name").agg(
        F.max("_o").alias("_o"), F.max(known).alias("_ko"),
        F.when(nulls, F.max("count")).otherwise(F.max_by("count", "_o")).alias("count"),
        F.when(F.max(known).isNull(), F.max("change")).otherwise(F.max_by("change", known)).alias("change"))
    # A row without an order value is older than any other.
    last = F.struct(F.col("_o").isNotNull(), "_o")
    known = F.when(F.col("change").isNotNull(), F.struct(F.col("_ko").isNotNull(), "_ko"))
    return (rows.groupBy("_k").agg(F.max_by("_name", last).alias("name"), F.max_by("count", last).alias("count"),
                                   F.max_by("change", known).alias("change"))
            .withColumnRenamed("_k", key))


def normalised_count(state: DataFrame) -> DataFrame:
    """Adds ``share`` = count / the largest latest count (a scalar subquery,
    computed once; no global sort and no single-partition window). The state
    (one row per city) is checkpointed first so the subquery and the main
    plan read it instead of recomputing the update stream twice."""
    state = state.checkpoint(eager=True)
    max_count = state.select(F.max("count")).scalar()
    return state.withColumn("share", F.try_divide(F.col("count").cast("double"), max_count.cast("double")))


def map_snapshot(enriched: DataFrame, order: list[str], key: str = "city_id") -> DataFrame:
    """Latest state per city as the map shows it: share of the largest count,
    change ratio, marker radius and fill opacity; cities with count 0 are not
    shown. (key, name, count, change, share, ratio, radius, fill_opacity)."""
    st = normalised_count(latest_state(enriched, order, key))
    st = st.withColumn("ratio", change_ratio("change", "count"))
    style = map_style("share", "ratio")
    return (st.where(F.col("count") > 0)
              .select(key, "name", "count", "change", "share", "ratio",
                      style["radius"].alias("radius"), style["fill_opacity"].alias("fill_opacity")))


def encode_event(whole: bool = False) -> Column:
    """The map event as JSON: count, feature (object or null), change. With ``whole``
    the feature is the city's text as it was read (column ``feature_text``), with all
    fields it came with."""
    if whole:
        null = F.lit("null")
        return F.concat(F.lit('{"count":'), F.coalesce(F.col("count").cast("string"), null), F.lit(',"feature":'),
                        F.coalesce(F.col("feature_text"), null), F.lit(',"change":'),
                        F.coalesce(F.col("change").cast("string"), null), F.lit("}"))
    return F.to_json(F.struct("count", "feature", "change"), {"ignoreNullFields": "false"})
