"""Registered queries: one per operator of the inventory, each reading the
driver's tables (or data Spark derives from them) so its work grows with
them. Every callable takes (spark, sf_dir) and returns a DataFrame whose
columns are named exactly as in the SQL twin in ``floodflow.oracle_sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodflow import schemas
from floodflow.functions.columns import sampling_weight, tolerant_long, with_cell
from floodflow.operators.nearest import has_nearer
from floodflow.operators.relational import argmin_rows, fill_nulls, select_distinct
from floodflow.operators.sample import weighted_sample
from floodflow.plans import relocate, snapshot, totals
from floodflow.sources import codecs, files, geojson, raster, tables
from floodflow.sources.tables import CELL_SIZE, SEA_LEVEL, WINDOW

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- batch side

def _stages(spark, sf) -> relocate.Stages:
    return relocate.stages(tables.nodes(spark, sf), tables.elevation_points(spark, sf),
                           SEA_LEVEL, CELL_SIZE)


def _places(spark, sf) -> DataFrame:
    return relocate.all_places(relocate.filter_nodes(tables.nodes(spark, sf)), CELL_SIZE)


@query
def with_cell_key(spark, sf):
    return _places(spark, sf).select("id", "cy", "cx")


@query
def cell_elevation(spark, sf):
    return relocate.cell_elevation(tables.elevation_points(spark, sf), CELL_SIZE)


@query
def bounded_scan(spark, sf):
    places = _places(spark, sf)
    elev = relocate.bounded_elevation(tables.elevation_points(spark, sf), places, CELL_SIZE)
    return relocate.cell_elevation(elev, CELL_SIZE)


@query
def raster_scan(spark, sf):
    """The raster written along the curve, read by the intervals that hold places."""
    path = files.shared_dir(spark, "raster")
    raster.write_raster(tables.elevation_points(spark, sf), path, CELL_SIZE)
    return relocate.cell_elevation(raster.read_cells(spark, path, _places(spark, sf), CELL_SIZE), CELL_SIZE)


@query
def threshold_filter(spark, sf):
    return cell_elevation(spark, sf).where(F.col("avg_elevation") >= F.lit(SEA_LEVEL))


@query
def min_by_key(spark, sf):
    e = with_cell(tables.elevation_points(spark, sf), size=CELL_SIZE)
    return e.groupBy("cy", "cx").agg(F.min("elevation").alias("min_elevation"))


@query
def argmin_rows_query(spark, sf):
    e = with_cell(tables.elevation_points(spark, sf), size=CELL_SIZE) \
        .withColumn("cell", F.col("cy") * F.lit(100000) + F.col("cx"))
    return argmin_rows(e, "cell", "elevation").select("cy", "cx", "lat", "lon", "elevation")


@query
def project(spark, sf):
    f = relocate.filter_nodes(tables.mixed_nodes(spark, sf))
    return f.select(F.col("id").alias("node_id"), "lat", "lon")


@query
def map_lookup(spark, sf):
    t = F.col("tags")
    return tables.mixed_nodes(spark, sf).select(
        "id", t["place"].alias("place"), t["population"].alias("population_text"),
        t["name"].alias("name"), t["harbour"].alias("harbour"))


@query
def in_list(spark, sf):
    n = tables.mixed_nodes(spark, sf)
    return n.where(F.col("tags")["place"].isin(relocate.PLACE_TAGS)).select("id")


@query
def place_filter(spark, sf):
    return relocate.filter_nodes(tables.mixed_nodes(spark, sf)).select("id", "lat", "lon")


@query
def hidden_column_filter(spark, sf):
    # Filter on a column that the projection dropped: the analyzer adds it back.
    return _places(spark, sf).select("id", "name", "place").where(F.col("place") == "city") \
        .select("id", "name")


@query
def select_distinct_query(spark, sf):
    return select_distinct(_places(spark, sf), "cy", "cx")


@query
def tolerant_cast(spark, sf):
    return tables.population_texts(spark, sf).select(
        "c_custkey", "text", tolerant_long("text").alias("value"))


@query
def places_to_relocate(spark, sf):
    return _stages(spark, sf).to_relocate


@query
def safe_cities(spark, sf):
    return _stages(spark, sf).safe_cities


@query
def nearest_city(spark, sf):
    return relocate.nearest_city(_stages(spark, sf))


@query
def nearest_harbour(spark, sf):
    return relocate.nearest_harbour(_stages(spark, sf))


@query
def combine_nearest(spark, sf):
    return relocate.combine_nearest(_stages(spark, sf))


def _split(spark, sf):
    return relocate.split_combined(_stages(spark, sf))


@query
def split_match(spark, sf):
    return _split(spark, sf)[0]


@query
def split_rest(spark, sf):
    return _split(spark, sf)[1]


@query
def nearer_harbour_exists(spark, sf):
    st = _stages(spark, sf)
    city = relocate.nearest_city(st).groupBy("id").agg(F.min("cityDistance").alias("cityDistance"))
    left = st.to_relocate.select("id", "lat", "lon").join(city, "id", "inner")
    return has_nearer(left, st.harbours, "id", "cityDistance").select("id")


@query
def partial_relocation(spark, sf):
    return relocate.partial_rows(_split(spark, sf)[0])


@query
def union_all(spark, sf):
    return relocate.relocation_rows(_stages(spark, sf))


@query
def sum_by_destination(spark, sf):
    st = _stages(spark, sf)
    return relocate.arrivals(st, relocate.moves(st))


@query
def fill_nulls_query(spark, sf):
    st = _stages(spark, sf)
    t = relocate.arrivals(st, relocate.moves(st))
    j = t.join(st.safe_cities.select("destinationId", "destination", "destinationPopulation"),
               "destinationId", "left")
    return fill_nulls(j, number=0, text=relocate.FILL_NAME)


@query
def relocations(spark, sf):
    return relocate.relocations(tables.nodes(spark, sf), tables.elevation_points(spark, sf),
                                SEA_LEVEL, CELL_SIZE)


@query
def destinations(spark, sf):
    return relocate.destinations(tables.nodes(spark, sf), tables.elevation_points(spark, sf),
                                 SEA_LEVEL, CELL_SIZE)


@query
def schema_contract(spark, sf):
    return tables.elevation_points(spark, sf).to(schemas.ELEVATION)


@query
def parquet_scan(spark, sf):
    path = files.shared_dir(spark, "elevation")
    tables.elevation_points(spark, sf).write.parquet(path)
    return files.read_elevation(spark, path)


@query
def orc_scan(spark, sf):
    path = files.shared_dir(spark, "nodes")
    files.write_orc(tables.nodes(spark, sf), path)
    n = files.read_nodes(spark, path)
    t = F.col("tags")
    return n.select("id", "lat", "lon", t["place"].alias("place"), t["name"].alias("name"),
                    t["population"].alias("population_text"), t["harbour"].alias("harbour"))


@query
def orc_sink(spark, sf):
    out = files.shared_dir(spark, "run")
    rel, _ = relocate.run(tables.nodes(spark, sf), tables.elevation_points(spark, sf),
                          SEA_LEVEL, out, CELL_SIZE)
    return files.read_orc(spark, rel, schemas.RELOCATIONS)


@query
def sampling_weight_query(spark, sf):
    return _places(spark, sf).select("id", "population",
                                     sampling_weight("population").alias("weight"))


@query
def weighted_sample_query(spark, sf):
    p = _places(spark, sf).select("id", "name", "population")
    return weighted_sample(p, "id", sampling_weight("population"), k=10, seed=42) \
        .select("id", "name", "population")


@query
def key_casts(spark, sf):
    c = tables.table(spark, sf, "customer")
    text = F.col("c_custkey").cast("string")
    return c.select("c_custkey", text.alias("key_text"), text.cast("bigint").alias("id_back"))


# --------------------------------------------------------------- stream side

def _events(spark, sf):
    return tables.city_events(spark, sf)


@query
def first_name(spark, sf):
    return totals.first_name(_events(spark, sf))


@query
def window_change(spark, sf):
    return totals.window_change(_events(spark, sf), WINDOW)


@query
def running_total(spark, sf):
    return totals.running_total(_events(spark, sf), WINDOW)


@query
def dense_window_totals(spark, sf):
    return totals.dense_window_totals(_events(spark, sf), WINDOW)


@query
def stream_updates(spark, sf):
    """The keyed-state stream over the events table, run to completion.
    (Event derivation as in ``tables.city_events``; the table is read as a
    stream in place, not copied.)"""
    from floodflow.streaming import runner
    return runner.run_table(spark, sf, "events.parquet", window_seconds=3600)


@query
def stream_topic(spark, sf):
    """The same job on a message topic that is written, in steps of event time, while
    the job reads it in several micro-batches."""
    from floodflow.streaming import runner
    return runner.run_topic(spark, runner.table_events(tables.table(spark, sf, "events")), window_seconds=3600)


def _update_rows(spark, sf):
    return totals.dense_window_totals(_events(spark, sf), WINDOW)


@query
def kafka_record_shape(spark, sf):
    return codecs.encode_record(_update_rows(spark, sf), "city_id",
                                ["city_id", "city_name", "refugees", "change"])


@query
def json_decode_strict(spark, sf):
    ev = _events(spark, sf).select(
        "event_id",
        F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
                           "city_id", "city_name", "refugees")).alias("value"))
    d = ev.select("event_id", codecs.decode_strict("value", schemas.EVENT).alias("e"))
    return d.select("event_id", "e.timestamp", "e.city_id", "e.city_name", "e.refugees")


@query
def json_decode_tolerant(spark, sf):
    return codecs.decode_tolerant(tables.update_texts(spark, sf), "value")


@query
def latest_per_key(spark, sf):
    d = codecs.decode_tolerant(tables.update_texts(spark, sf), "value")
    return snapshot.latest_per_key(d.where(F.col("city_id").isNotNull()), "city_id", "refugees",
                                   ["ts", "event_id"])


@query
def latest_non_null(spark, sf):
    d = codecs.decode_tolerant(tables.update_texts(spark, sf), "value")
    return snapshot.latest_non_null(d.where(F.col("city_id").isNotNull()), "city_id", "change",
                                    ["ts", "event_id"])


def _city_features(spark, sf, versions: bool) -> DataFrame:
    path = files.shared_dir(spark, "cities")
    geojson.write_collections(tables.city_features(spark, sf, versions), path, ["k", "version"])
    return geojson.read_features(spark, path)


@query
def geojson_features(spark, sf):
    return geojson.cities_lenient(_city_features(spark, sf, versions=False))


@query
def geojson_last_wins(spark, sf):
    return geojson.cities_strict(_city_features(spark, sf, versions=True)).drop("feature", "feature_text")


def _enriched(spark, sf):
    cities = geojson.cities_strict(_city_features(spark, sf, versions=True)).checkpoint(eager=True)
    # Every seventh city reports a count of 0, which the map does not show.
    rows = _update_rows(spark, sf).withColumn(
        "refugees", F.when(F.col("city_id") % 7 == 0, F.lit(0).cast("long")).otherwise(F.col("refugees")))
    texts = rows.select("window_start",
                        F.to_json(F.struct("city_id", "city_name", "refugees", "change")).alias("value"))
    return snapshot.enrich_updates(codecs.decode_tolerant(texts, "value"), cities)


@query
def enrich_updates(spark, sf):
    e = _enriched(spark, sf)
    return e.select("city_id", "window_start", "count", "change",
                    F.col("feature.properties.geoname_id").alias("feature_id"),
                    F.col("feature.properties.name").alias("feature_name"),
                    F.col("feature.properties.population").alias("feature_population"))


@query
def json_encode(spark, sf):
    return _enriched(spark, sf).select(snapshot.encode_event(whole=True).alias("event"))


@query
def normalised_count(spark, sf):
    st = snapshot.latest_state(_enriched(spark, sf), ["window_start"])
    return snapshot.normalised_count(st).select("city_id", "count", "share")


@query
def change_ratio_query(spark, sf):
    from floodflow.functions.columns import change_ratio
    st = snapshot.latest_state(_enriched(spark, sf), ["window_start"])
    return st.select("city_id", "count", "change", change_ratio("change", "count").alias("ratio"))


@query
def map_snapshot(spark, sf):
    return snapshot.map_snapshot(_enriched(spark, sf), ["window_start"])


# Registry names as listed in the inventory (some functions carry a suffix to
# avoid shadowing library names).
RENAMES = {
    "with_cell_key": "with_cell",
    "argmin_rows_query": "argmin_rows",
    "select_distinct_query": "select_distinct",
    "fill_nulls_query": "fill_nulls",
    "sampling_weight_query": "sampling_weight",
    "weighted_sample_query": "weighted_sample",
    "change_ratio_query": "change_ratio",
}


def registry() -> dict[str, Query]:
    return {RENAMES.get(k, k): v for k, v in QUERIES.items()}
