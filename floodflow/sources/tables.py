"""Inputs derived from the driver's tables (TPC-H-like star schema plus an
event table). The driver tables carry no coordinates, so positions,
elevations and populations follow fixed integer rules; both Spark and the
SQL oracle apply the same rules.

Fixed values (derivation rules, all arithmetic on integers, then one double
division so both engines produce the same IEEE values):
  elevation point from orders:
    lat = double(o_orderkey * 7919 mod 1800) / 100 + 40
    lon = double(o_orderkey * 104729 mod 3600) / 100
    elevation = int(o_orderkey * 31 mod 40) - 5
  place from customer:
    id = c_custkey, name = c_name, population = c_custkey * 13 + 7
    lat = double(c_custkey * 6151 mod 1800) / 100 + 40
    lon = double(c_custkey * 3571 mod 3600) / 100
    place = 'city' if c_mktsegment = 'BUILDING' else 'town'
  harbour from supplier:
    lat = double(s_suppkey * 4093 mod 1800) / 100 + 40
    lon = double(s_suppkey * 2741 mod 3600) / 100
  further node from part, by k = p_partkey mod 6 (what the node filter must tell apart):
    id = 1000000000 + p_partkey, position as for places from p_partkey
    0 place 'suburb' (not listed), 1 place 'town' without population, 2 place 'village'
    without lat, 3 harbour 'no', 4 harbour 'yes' without lon, 5 place 'hamlet'
    name = p_name, population = p_partkey where there is one
  elevation cell: 0.5 degrees; sea level: 12
  city stream from events:
    city_id = user_id, city_name = event_type,
    refugees = bigint(round(value * 100)), order (ts, event_id), window 1 hour
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodflow import schemas

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

CELL_SIZE = 0.5
SEA_LEVEL = 12
WINDOW = "1 hour"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _coord(key: str, mul: int, mod: int, offset: float):
    v = (F.col(key) * F.lit(mul)) % F.lit(mod)
    out = v.cast("double") / F.lit(100.0)
    return out + F.lit(offset) if offset else out


def elevation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.select(
        _coord("o_orderkey", 7919, 1800, 40.0).alias("lat"),
        _coord("o_orderkey", 104729, 3600, 0.0).alias("lon"),
        (((F.col("o_orderkey") * F.lit(31)) % F.lit(40)).cast("int") - F.lit(5)).alias("elevation"),
    ).to(schemas.ELEVATION)


def place_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    population = F.col("c_custkey") * F.lit(13) + F.lit(7)
    place = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("city")).otherwise(F.lit("town"))
    return c.select(
        F.col("c_custkey").alias("id"),
        F.create_map(F.lit("place"), place,
                     F.lit("population"), population.cast("string"),
                     F.lit("name"), F.col("c_name")).alias("tags"),
        _coord("c_custkey", 6151, 1800, 40.0).alias("lat"),
        _coord("c_custkey", 3571, 3600, 0.0).alias("lon"),
    )


def harbour_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        (-F.col("s_suppkey")).alias("id"),
        F.create_map(F.lit("harbour"), F.lit("yes")).alias("tags"),
        _coord("s_suppkey", 4093, 1800, 40.0).alias("lat"),
        _coord("s_suppkey", 2741, 3600, 0.0).alias("lon"),
    )


def odd_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes most of which the job's node filter rejects, each kind for one reason."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k, key = F.col("p_partkey") % F.lit(6), F.col("p_partkey")
    kind = F.when(k == 0, F.lit("suburb")).when(k == 1, F.lit("town")).when(k == 2, F.lit("village")).otherwise(F.lit("hamlet"))
    population = F.when(k != 1, key.cast("string"))
    tags = (F.when(k == 3, F.create_map(F.lit("harbour"), F.lit("no")))
             .when(k == 4, F.create_map(F.lit("harbour"), F.lit("yes")))
             .when(k == 1, F.create_map(F.lit("place"), kind, F.lit("name"), F.col("p_name")))
             .otherwise(F.create_map(F.lit("place"), kind, F.lit("population"), population, F.lit("name"), F.col("p_name"))))
    return p.select((key + F.lit(1_000_000_000)).alias("id"), tags.alias("tags"),
                    F.when(k != 2, _coord("p_partkey", 6151, 1800, 40.0)).alias("lat"),
                    F.when(k != 4, _coord("p_partkey", 3571, 3600, 0.0)).alias("lon"))


def mixed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nodes`` and the odd ones."""
    return _whole(place_nodes(spark, sf_dir).unionByName(harbour_nodes(spark, sf_dir))
                  .unionByName(odd_nodes(spark, sf_dir)))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map nodes in the full 13-column node schema (unused columns null)."""
    return _whole(place_nodes(spark, sf_dir).unionByName(harbour_nodes(spark, sf_dir)))


def _whole(both: DataFrame) -> DataFrame:
    rest = [F.lit(None).cast(f.dataType).alias(f.name)
            for f in schemas.NODES.fields if f.name not in ("id", "tags", "lat", "lon")]
    return both.select("id", "tags", "lat", "lon", *rest).to(schemas.NODES)


def city_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, event_id, city_id, city_name, refugees) from the events table."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("ts"), F.col("event_id"),
        F.col("user_id").alias("city_id"),
        F.col("event_type").alias("city_name"),
        F.round(F.col("value") * F.lit(100.0)).cast("long").alias("refugees"),
    )


def population_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population tags in the shapes seen in map data, from customer keys.

    Fixed rule on k = c_custkey mod 8: 0 plain digits, 1 padded with blanks,
    2 with a fraction '.7', 3 with a thousands comma, 4 with an exponent,
    5 empty, 6 null, 7 signed '+'."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    n = F.col("c_custkey").cast("string")
    k = F.col("c_custkey") % F.lit(8)
    text = (F.when(k == 0, n)
             .when(k == 1, F.concat(F.lit(" "), n, F.lit(" ")))
             .when(k == 2, F.concat(n, F.lit(".7")))
             .when(k == 3, F.concat(F.lit("1,"), n))
             .when(k == 4, F.concat(n, F.lit("e3")))
             .when(k == 5, F.lit(""))
             .when(k == 6, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("+"), n)))
    return c.select("c_custkey", text.alias("text"))


def update_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update messages as JSON text, with the defects a tolerant reader must
    survive. (ts, event_id, value).

    Fixed rule on k = event_id mod 10: 0-4 a full update (change = refugees
    mod 100); 5 the same with a null change; 6 refugees missing; 7 refugees
    negative; 8 broken JSON; 9 no city id and a null change."""
    e = city_events(spark, sf_dir)
    k = F.col("event_id") % F.lit(10)
    cid, name = F.col("city_id").cast("string"), F.col("city_name")
    r = F.col("refugees").cast("string")
    full = F.concat(F.lit('{"city_id":'), cid, F.lit(',"city_name":"'), name, F.lit('","refugees":'), r,
                    F.lit(',"change":'), (F.col("refugees") % F.lit(100)).cast("string"), F.lit("}"))
    quiet = F.concat(F.lit('{"city_id":'), cid, F.lit(',"refugees":'), r, F.lit(',"change":null}'))
    text = (F.when(k <= 4, full)
             .when(k == 5, quiet)
             .when(k == 6, F.concat(F.lit('{"city_id":'), cid, F.lit(',"change":1}')))
             .when(k == 7, F.concat(F.lit('{"city_id":'), cid, F.lit(',"refugees":-'),
                                    (F.col("refugees") + F.lit(1)).cast("string"), F.lit(',"change":0}')))
             .when(k == 8, F.concat(F.lit('{"refugees":'), r, F.lit(",")))
             .otherwise(F.concat(F.lit('{"refugees":'), r, F.lit(',"change":null}'))))
    return e.select("ts", "event_id", text.alias("value"))


def city_features(spark: SparkSession, sf_dir: str, versions: bool) -> DataFrame:
    """City features from customer rows: (k, version, feature JSON text).

    Fixed rules: geoname_id = string(c_custkey), name = c_name, position as
    for places. Without versions: population = floor(abs(c_acctbal) * 100),
    absent when c_acctbal < 0. With versions every customer appears twice,
    version 0 with population c_custkey * 1000 + 7, then version 1 with
    floor(abs(c_acctbal) * 100)."""
    from floodflow.sources.geojson import feature_json
    c = table(spark, sf_dir, "customer")
    gid = F.col("c_custkey").cast("string")
    lat = _coord("c_custkey", 6151, 1800, 40.0)
    lon = _coord("c_custkey", 3571, 3600, 0.0)
    bal = F.floor(F.abs(F.col("c_acctbal")) * F.lit(100.0)).cast("long")
    if not versions:
        pop = F.when(F.col("c_acctbal") >= 0, bal)
        out = c.select(F.col("c_custkey").alias("k"), F.lit(0).alias("version"),
                       feature_json(gid, F.col("c_name"), pop, lon, lat).alias("feature"))
        return out
    v = c.select("c_custkey", "c_name", "c_acctbal",
                 F.explode(F.array(F.lit(0), F.lit(1))).alias("version"))
    pop = F.when(F.col("version") == 0, F.col("c_custkey") * F.lit(1000) + F.lit(7)).otherwise(bal)
    out = v.select(F.col("c_custkey").alias("k"), "version",
                   feature_json(gid, F.col("c_name"), pop, lon, lat).alias("feature"))
    return out
