"""Batch relocation: who must move where, and how large each destination
becomes, for a given sea level.

Semantics follow the reference job step by step:
  * a node is kept when it is (a place of a listed kind with a population
    tag, or a harbour) and has coordinates; a node can be both;
  * average elevation per cell; a cell is safe when the average >= level;
  * places in cells that are not safe relocate (a place in a cell without
    elevation data relocates too); cities in safe cells are destinations;
  * each relocating place goes to its nearest safe city; when some harbour
    is strictly nearer than that city, 75 % go to the city and 25 % to the
    harbour (destination id -1, named "Waterworld"), each part rounded
    half-up on its own; ties in either distance keep every row;
  * outputs name places and destinations; missing names become
    "Waterworld"; destinations add up arrivals by city id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodflow.functions.columns import CITY_SHARE, HARBOUR_SHARE, tolerant_long, with_cell
from floodflow.operators.nearest import at_locations, nearest_join, nearest_locations
from floodflow.operators.relational import BROADCAST_BYTES, fill_nulls, maybe_broadcast, split
from floodflow.sources.files import materialize
from floodflow.sources.raster import read_cells

# Fixed values from the reference job.
PLACE_TAGS = ["city", "town", "village", "hamlet"]
HARBOUR_ID = -1
FILL_NAME = "Waterworld"
#: Rows that ties write out: of one row in one piece, and by one task.
PIECE_ROWS, TASK_ROWS = 100_000, 2_000_000

CELL = ["cy", "cx"]
COMBINED = ["id", "destinationId", "cityDistance", "harbourDistance", "population"]


@dataclass
class Stages:
    """Intermediate frames of one run, exposed for queries and tests."""
    filtered: DataFrame
    places: DataFrame
    cell_elevation: DataFrame
    safe_cells: DataFrame
    to_relocate: DataFrame
    safe_cities: DataFrame
    harbours: DataFrame


def _is_place(tags=None):
    tags = F.col("tags") if tags is None else tags
    return tags["place"].isin(PLACE_TAGS) & tags["population"].isNotNull()


def _is_harbour(tags=None):
    tags = F.col("tags") if tags is None else tags
    return tags["harbour"] == "yes"


def filter_nodes(nodes: DataFrame) -> DataFrame:
    """(place with population, or harbour) and coordinates present."""
    return (nodes.select("id", "tags", "lat", "lon")
            .where((_is_place() | _is_harbour()) & F.col("lat").isNotNull() & F.col("lon").isNotNull()))


def normalise_nodes(filtered: DataFrame) -> DataFrame:
    """Map lookups as top-level columns. Written once (e.g. to Parquet), the
    tag predicates become pushable scan filters."""
    t = F.col("tags")
    return filtered.select("id", "lat", "lon", t["place"].alias("place"), t["name"].alias("name"),
                           t["population"].alias("population_text"), t["harbour"].alias("harbour"))


def all_places(filtered: DataFrame, cell_size: float, cell_fn=None) -> DataFrame:
    """(id, name, population, place, cy, cx, lat, lon); ``place`` is kept so
    later filters read a projected column."""
    t = F.col("tags")
    places = filtered.where(_is_place()).select(
        "id", t["name"].alias("name"), tolerant_long(t["population"]).alias("population"),
        t["place"].alias("place"), "lat", "lon")
    return with_cell(places, size=cell_size, cell_fn=cell_fn)


def cell_elevation(elevation: DataFrame, cell_size: float, cell_fn=None) -> DataFrame:
    """(cy, cx, avg_elevation). Partial aggregation runs before the shuffle,
    so one row per cell and map task crosses the network."""
    cols = CELL if cell_fn is None else CELL[:1]
    return (with_cell(elevation, size=cell_size, cell_fn=cell_fn)
            .groupBy(*cols).agg(F.avg("elevation").alias("avg_elevation")))


def bounded_elevation(elevation: DataFrame, places: DataFrame, cell_size: float,
                      broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Only raster points in cells that hold a place matter. First a range
    filter on the places' bounding box, widened to whole cells (it reaches the
    Parquet reader as pushed filters), then a semi join with the occupied
    cells, which their measured size broadcasts or shuffles; the rows are the
    same either way. One box for all places suits a regional raster; a raster of
    the planet is written along a curve (``sources/raster.py``) and read by the
    intervals that hold places."""
    b = places.agg(F.min("cy"), F.max("cy"), F.min("cx"), F.max("cx")).first()
    if b[0] is None:
        return elevation.where(F.lit(False))
    s = float(cell_size)
    # One cell of margin on each side: the box only has to be a superset;
    # the semi join below decides exactly, with the same cell expression.
    boxed = elevation.where(
        (F.col("lat") >= F.lit((b[0] - 1) * s)) & (F.col("lat") < F.lit((b[1] + 2) * s)) &
        (F.col("lon") >= F.lit((b[2] - 1) * s)) & (F.col("lon") < F.lit((b[3] + 2) * s)))
    occupied = maybe_broadcast(places.select(*CELL).distinct(), broadcast_bytes)
    return (with_cell(boxed, size=cell_size)
            .join(occupied, CELL, "left_semi")
            .drop(*CELL))


def stages(nodes: DataFrame, elevation: DataFrame | str, sea_level: float, cell_size: float = 0.5,
           bounded: bool = True, cell_fn=None) -> Stages:
    """``elevation``: raster points, or the path of a raster that ``write_raster`` wrote
    with this cell size, of which only the intervals with places are read."""
    # The node scan and the raster aggregation are the expensive parts; both
    # results are small and are read several times, so they are written once
    # to the shared checkpoint folder (this also cuts the lineage).
    filtered = materialize(filter_nodes(nodes), "nodes")
    places = all_places(filtered, cell_size, cell_fn)
    if isinstance(elevation, str):
        elevation = read_cells(nodes.sparkSession, elevation, places, cell_size)
    elif bounded and cell_fn is None:
        elevation = bounded_elevation(elevation, places, cell_size)
    elev = cell_elevation(elevation, cell_size, cell_fn)
    cell_cols = CELL if cell_fn is None else ["cy"]
    safe = elev.where(F.col("avg_elevation") >= F.lit(sea_level)).select(*cell_cols)
    safe = materialize(safe, "safe-cells")
    # Both are read by each nearest join and by the lookups after it: written once.
    to_relocate = materialize(places.join(safe, cell_cols, "left_anti")
                              .select("id", "population", "lat", "lon"), "to-relocate")
    cities = materialize(places.where(F.col("place") == "city")
                         .join(safe, cell_cols, "inner")
                         .select(F.col("id").alias("destinationId"), F.col("name").alias("destination"),
                                 F.col("population").alias("destinationPopulation"), "lat", "lon"), "safe-cities")
    harbours = filtered.where(_is_harbour()).select("lat", "lon")
    return Stages(filtered, places, elev, safe, to_relocate, cities, harbours)


def nearest_city(st: Stages) -> DataFrame:
    """(id, destinationId, cityDistance), ties kept."""
    return nearest_join(st.to_relocate.select("id", "lat", "lon"),
                        st.safe_cities.select("destinationId", "lat", "lon"),
                        "id", distance="cityDistance")


def nearest_harbour(st: Stages) -> DataFrame:
    """(id, harbourDistance), one row per nearest harbour (ties kept)."""
    return nearest_join(st.to_relocate.select("id", "lat", "lon"), st.harbours,
                        "id", distance="harbourDistance")


def moves(st: Stages) -> DataFrame:
    """Who goes where, with ties counted instead of written out: (id, population, rlat,
    rlon, cities, cityDistance, harbourDistance, harbours), a row for each relocating
    place and nearest city location, with the number of cities there and of nearest
    harbours. Inner joins: with no harbour or no safe city at all it is empty. Written
    once; it grows with the places, not with the product of their ties.

    The two searches are independent, so their jobs are submitted from two
    driver threads and share the cluster."""
    from concurrent.futures import ThreadPoolExecutor
    left = st.to_relocate.select("id", "lat", "lon")
    with ThreadPoolExecutor(max_workers=2) as pool:
        city = pool.submit(nearest_locations, left, st.safe_cities.select("lat", "lon"), "id", distance="cityDistance")
        harbour = pool.submit(nearest_locations, left, st.harbours, "id", distance="harbourDistance")
        city, harbour = city.result(), harbour.result()
    # All rows of an id are at one distance, and only their number matters.
    harbour = harbour.groupBy("id", "harbourDistance").agg(F.sum("m").alias("harbours"))
    return materialize(city.withColumnRenamed("m", "cities").join(harbour, "id", "inner")
                       .join(st.to_relocate.select("id", "population"), "id", "inner"), "moves")


def _dealt(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Rows of ``moves`` once for each of their cities, ``harbours`` still counted. The rows
    are cut in pieces and dealt out by what they will make."""
    total = rows.agg(F.sum(F.col("cities").cast("double") * F.col("harbours"))).first()[0] or 0.0
    piece = F.greatest(F.lit(1), F.expr(f"{PIECE_ROWS} div cities"))
    rows = (rows.withColumn("_piece", piece)
            .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(harbours - 1) div _piece"))))
            .withColumn("harbours", F.least("_piece", F.col("harbours") - F.col("_i") * F.col("_piece")))
            .drop("_piece", "_i"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(total // TASK_ROWS) + 1)
    return at_locations(rows.repartition(tasks), cities).drop("rlat", "rlon", "cities")


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row once for each of its harbours: streamed to its reader, neither sorted nor
    shuffled nor kept."""
    return rows.withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("harbours").cast("int")))).drop("harbours", "_i")


def _written_out(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Rows of ``moves`` once for each of their cities and harbours."""
    return _repeated(_dealt(rows, cities))


def _split_moves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(harbour strictly nearer, not nearer)."""
    return split(rows, F.col("harbourDistance") < F.col("cityDistance"))


def _city_rows(st: Stages) -> DataFrame:
    return st.safe_cities.select("lat", "lon", "destinationId")


def combine_nearest(st: Stages) -> DataFrame:
    """(id, destinationId, cityDistance, harbourDistance, population), a row for each pair
    of a nearest city and a nearest harbour."""
    return _written_out(moves(st), _city_rows(st)).select(*COMBINED)


def _shares(population: str = "population") -> tuple[F.Column, F.Column]:
    """75 % and 25 %, each rounded half-up on its own (they may add up to one more)."""
    return tuple(F.round(F.col(population) * F.lit(s)).cast("long") for s in (CITY_SHARE, HARBOUR_SHARE))


def partial_rows(harbour_nearer: DataFrame) -> DataFrame:
    """75 % of the population to the city and 25 % to the harbour (id -1)."""
    to_city, to_harbour = _shares()
    both = F.array(F.struct(to_city.alias("num_evacuees"), F.col("destinationId").cast("long").alias("destinationId")),
                   F.struct(to_harbour.alias("num_evacuees"), F.lit(HARBOUR_ID).cast("long").alias("destinationId")))
    return harbour_nearer.select("id", F.inline(both))


def split_combined(st: Stages) -> tuple[DataFrame, DataFrame]:
    """(harbour strictly nearer, not nearer) over the combined nearest rows. The moves are
    split, so both parts are written out from the same result."""
    nearer, rest = (_written_out(part, _city_rows(st)).select(*COMBINED) for part in _split_moves(moves(st)))
    return nearer, rest


def relocation_rows(st: Stages) -> DataFrame:
    """(id, num_evacuees, destinationId): whole moves, or 75/25 splits."""
    harbour_nearer, city_only = split_combined(st)
    whole = city_only.select("id", F.col("population").alias("num_evacuees"), "destinationId")
    return whole.unionByName(partial_rows(harbour_nearer))


def arrivals(st: Stages, rows: DataFrame) -> DataFrame:
    """(destinationId, arrivals): the relocation rows of ``moves`` added up by destination
    without being written out, as all cities at one location receive the same."""
    to_city, to_harbour = _shares()
    near = F.col("harbourDistance") < F.col("cityDistance")
    per_spot = rows.groupBy("rlat", "rlon").agg(F.sum(
        F.when(near, to_city).otherwise(F.col("population")) * F.col("harbours")).alias("arrivals"))
    sea = rows.where(near).select(F.lit(HARBOUR_ID).cast("long").alias("destinationId"),
                                  (to_harbour * F.col("harbours") * F.col("cities")).alias("arrivals"))
    return (at_locations(per_spot, _city_rows(st)).select("destinationId", "arrivals").unionByName(sea)
            .groupBy("destinationId").agg(F.sum("arrivals").alias("arrivals")))


def _city_names(st: Stages, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Safe-city names for lookups. Every harbour row carries id -1, a hot
    key; broadcasting the (measured) city table keeps that key out of
    any shuffle. Above the bound, AQE splits the skewed partition."""
    dests = st.safe_cities.select("destinationId", "destination", "destinationPopulation")
    return maybe_broadcast(dests, broadcast_bytes)


def relocations_from(st: Stages, rows: DataFrame) -> DataFrame:
    """(place, num_evacuees, destination)."""
    names = st.places.select("id", "name")
    dests = _city_names(st).select("destinationId", "destination")
    joined = (rows.join(names, "id", "left").join(dests, "destinationId", "left")
              .select("name", "num_evacuees", "destination"))
    return joined.na.fill(FILL_NAME).select(F.col("name").alias("place"), "num_evacuees", "destination")


def named_relocations(st: Stages, rows: DataFrame) -> DataFrame:
    """``relocations_from`` over ``moves``: names are looked up, shares taken and gaps filled
    before the harbours are written out, so the written rows are repeated and nothing else."""
    dests = st.safe_cities.select("destinationId", "destination")
    # An id of several cities finds all of their names, as a lookup of the written rows does.
    cities = _city_rows(st).join(dests, "destinationId", "left").select("lat", "lon", "destination")
    rows = materialize(rows.join(st.places.select("id", "name"), "id", "left"), "named-moves")
    near, rest = (_dealt(part, cities) for part in _split_moves(rows))
    to_city, to_harbour = _shares()
    parts = near.select("name", "harbours", F.inline(F.array(
        F.struct(to_city.alias("num_evacuees"), "destination", F.lit(False).alias("sea")),
        F.struct(to_harbour.alias("num_evacuees"), F.lit(None).cast("string").alias("destination"), F.lit(True).alias("sea")))))
    sea = dests.where(F.col("destinationId") == HARBOUR_ID).select(F.lit(True).alias("sea"), F.col("destination").alias("_sea"))
    parts = parts.join(F.broadcast(sea), "sea", "left").select(
        "name", "harbours", "num_evacuees", F.when(F.col("sea"), F.col("_sea")).otherwise(F.col("destination")).alias("destination"))
    whole = rest.select("name", "harbours", F.col("population").alias("num_evacuees"), "destination")
    whole, parts = (_repeated(part.na.fill(FILL_NAME).select(F.col("name").alias("place"), "num_evacuees", "destination", "harbours"))
                    for part in (whole, parts))
    return whole.unionByName(parts)


def destinations_from(st: Stages, rows: DataFrame) -> DataFrame:
    """(destination, old_population, new_population); cities that receive
    nobody are absent; the harbour row is "Waterworld" with old population 0."""
    return destinations_of(st, rows.groupBy("destinationId").agg(F.sum("num_evacuees").alias("arrivals")))


def destinations_of(st: Stages, totals: DataFrame) -> DataFrame:
    """``destinations_from`` over (destinationId, arrivals)."""
    joined = totals.join(_city_names(st), "destinationId", "left")
    filled = fill_nulls(joined, number=0, text=FILL_NAME)
    return filled.select(
        "destination", F.col("destinationPopulation").alias("old_population"),
        (F.col("destinationPopulation") + F.col("arrivals")).alias("new_population"))


def relocations(nodes: DataFrame, elevation: DataFrame | str, sea_level: float,
                cell_size: float = 0.5, **kw) -> DataFrame:
    st = stages(nodes, elevation, sea_level, cell_size, **kw)
    return named_relocations(st, moves(st))


def destinations(nodes: DataFrame, elevation: DataFrame | str, sea_level: float,
                 cell_size: float = 0.5, **kw) -> DataFrame:
    st = stages(nodes, elevation, sea_level, cell_size, **kw)
    return destinations_of(st, arrivals(st, moves(st)))


def run(nodes: DataFrame, elevation: DataFrame | str, sea_level: float, out_dir: str,
        cell_size: float = 0.5, mode: str = "errorifexists") -> tuple[str, str]:
    """Write both outputs as ORC under ``out_dir``, from the same moves; their ties are
    written out by the sink of the relocations only."""
    st = stages(nodes, elevation, sea_level, cell_size)
    rows = moves(st)
    rel_path, dst_path = f"{out_dir}/relocations", f"{out_dir}/destinations"
    named_relocations(st, rows).write.mode(mode).orc(rel_path)
    destinations_of(st, arrivals(st, rows)).write.mode(mode).orc(dst_path)
    return rel_path, dst_path
