"""Stateless enrichment of the update stream (stream-static join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodflow.plans.snapshot import encode_event, enrich_updates
from floodflow.sources.codecs import decode_tolerant


def enrich_stream(records: DataFrame, cities: DataFrame, cities_bytes: int | None = None) -> DataFrame:
    """Update records (key/value, streaming or not) -> map events.

    Bad records are dropped by the tolerant decoder; each update looks up its
    city (left join against the static, size-checked city table) and is
    written as JSON with nulls kept. Output: (key, value)."""
    upd = records.select(F.col("value").cast("string").alias("value"))
    enriched = enrich_updates(decode_tolerant(upd, "value"), cities, cities_bytes=cities_bytes)
    return enriched.select(
        F.col("feature.properties.geoname_id").alias("key"), encode_event("feature_text" in cities.columns).alias("value"))
