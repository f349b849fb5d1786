"""GeoJSON city tables: write a table as FeatureCollection documents and read
them back.

Writing produces one document per partition; reading takes every document as its own
task (``read_features``), or cuts huge documents at the beginnings of their features
(``split_features``), so no task or driver ever holds a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodflow import schemas

FEATURES_PER_FILE = 2_000


def feature_json(geoname_id, name, population, lon, lat) -> F.Column:
    """One Feature object as JSON text (point geometry, lon/lat order)."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(geoname_id.alias("geoname_id"), name.alias("name"),
                 population.alias("population")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry")))


def write_collections(features: DataFrame, path: str, order_cols: list[str],
                      rows: int | None = None) -> None:
    """Write ``features`` (column ``feature`` = Feature JSON text) as
    FeatureCollection documents, one per partition, features kept in
    ``order_cols`` order inside each document and documents in range order.
    A row id completes the order, so even a key that holds a third of all
    features is spread over several documents of bounded size; readers
    order by (document path, position)."""
    n = rows if rows is not None else features.count()
    parts = max(1, -(-n // FEATURES_PER_FILE))
    order_cols = [*order_cols, "_row"]
    ordered = (features.withColumn("_row", F.monotonically_increasing_id())
               .repartitionByRange(parts, *order_cols)
               .sortWithinPartitions(*order_cols))
    # One group per partition: bounded by FEATURES_PER_FILE rows.
    # Zero-padded document number: documents sort by path in key order.
    docs = (ordered.withColumn("_part", F.lpad(F.spark_partition_id().cast("string"), 10, "0"))
            .groupBy("_part")
            .agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order_cols],
                                                      F.col("feature")))).alias("fs"))
            .select(F.concat(F.lit('{"type":"FeatureCollection","features":['),
                             F.array_join(F.transform("fs", lambda s: s["feature"]), ","),
                             F.lit("]}")).alias("value"), "_part"))
    # One folder per document, so every file holds exactly one document.
    docs.write.mode("errorifexists").partitionBy("_part").text(path)


COLLECTION = "type string, features array<string>"
MARK = '{"type":"Feature"'


def _parsed(rows: DataFrame) -> DataFrame:
    """(doc, pos, text) with ``feature`` (the fields the jobs read; null where a field
    has another shape, so a polygon has no point) and ``whole``, the feature as VARIANT."""
    return rows.select("doc", "pos", "text", F.from_json("text", schemas.GEO_FEATURE).alias("feature"),
                       F.parse_json("text").alias("whole"))


def _members(kind: F.Column, features: F.Column) -> F.Column:
    return F.when((kind == "FeatureCollection") & features.isNotNull(), features).otherwise(
        F.raise_error(F.lit("not a FeatureCollection")))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(doc, pos, text, feature, whole): every feature with its document and position;
    ``text`` is the whole feature as JSON, byte for byte. A document that is no
    FeatureCollection fails the query. A document is one task's; see ``split_features``
    for huge ones.

    A document is read as one line, by a separator that JSON cannot hold, and parsed from
    its bytes in memory; the multi-line reader opens the file anew for every feature to
    copy its text, and reads many times the bytes."""
    coll = (spark.read.schema(COLLECTION).option("lineSep", "\x00")
            .option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)
            .withColumn("doc", F.input_file_name()))
    return _parsed(coll.select("doc", F.posexplode(_members(F.col("type"), F.col("features"))).alias("pos", "text")))


def split_features(spark: SparkSession, path: str, mark: str = MARK) -> DataFrame:
    """``read_features`` for documents too large for one task: they are cut by byte
    ranges at ``mark``, the text that every feature begins with (files differ in blanks
    and order of fields), so one document of any size is read by many tasks. What is
    before the first mark must open a FeatureCollection. A mark inside a feature cuts
    it, which fails the query: nothing is lost silently."""
    rows = (spark.read.option("lineSep", mark).option("recursiveFileLookup", "true").text(path)
            .select("value", F.input_file_name().alias("doc"),
                    F.struct(F.col("_metadata.file_block_start").alias("block"),
                             F.monotonically_increasing_id().alias("row")).alias("pos")))
    # A head begins with a brace, the rest of a feature with a comma or the closing brace.
    head = F.col("value").rlike(r"^\s*\{")
    kind = F.try_variant_get(F.try_parse_json(F.concat("value", F.lit("]}"))), "$.type", "string")
    text = F.when(~head, F.concat(F.lit(mark), "value")).when(
        kind == "FeatureCollection", F.lit(None)).otherwise(F.raise_error(F.lit("not a FeatureCollection")))
    rows = rows.select("doc", "pos", text.alias("text")).where(F.col("text").isNotNull())
    # The text goes on to the next mark; a parser stops at the end of the feature.
    return _parsed(rows).withColumn("text", F.to_json("whole"))


def _kind(field: str) -> F.Column:
    """JSON type of a property, null if it is absent."""
    return F.schema_of_variant(F.try_variant_get("whole", f"$.properties.{field}", "variant"))


def _flat(df: DataFrame) -> DataFrame:
    """Flatten. ``population`` is null unless it is an unsigned whole number (not a text),
    ``geoname_id`` and ``name`` unless they are texts."""
    p, g = F.col("feature.properties"), F.col("feature.geometry.coordinates")
    kind = F.coalesce(_kind("population"), F.lit(""))
    number = F.try_variant_get("whole", "$.properties.population", "decimal(20,0)")
    whole = (kind.startswith("BIGINT") | kind.rlike(r"^DECIMAL\([0-9]+,0\)")) & (number >= 0)
    # Parsed once per row: the checks below read plain columns.
    return df.select("doc", "pos", "text", "feature", F.explode(F.array(F.struct(
        F.when(_kind("geoname_id") == "STRING", p["geoname_id"]).alias("geoname_id"),
        F.when(_kind("name") == "STRING", p["name"]).alias("name"),
        F.when(whole, number.try_cast("long")).alias("population"), g[0].alias("lon"), g[1].alias("lat")))).alias("f")) \
        .select("doc", "pos", "text", "feature", "f.*")


_U64 = "^[0-9]+$"


def cities_lenient(features: DataFrame, min_population: int = 400_000) -> DataFrame:
    """Features that lack a property, or have one of another type, are skipped; an id
    that is not a number fails the query; only cities above ``min_population`` are kept.
    (city_id, name, population, lon, lat)."""
    f = _flat(features)
    lacks = F.col("geoname_id").isNull() | F.col("name").isNull() | F.col("population").isNull()
    # The check is part of what the filter reads, so it is made for every complete feature.
    checked = F.when(lacks, F.lit(None)).when(F.col("geoname_id").rlike(_U64), F.col("population")) \
        .otherwise(F.raise_error(F.concat(F.lit("bad geoname_id: "), F.col("geoname_id"))))
    return (f.withColumn("population", checked).where(F.col("population") > min_population)
             .select(F.col("geoname_id").cast("long").alias("city_id"), "name", "population", "lon", "lat"))


def cities_strict(features: DataFrame, min_population: int = 400_000) -> DataFrame:
    """Every feature, also one the filter would drop, must carry an unsigned population
    and an id that is a text of digits, else the query fails. Cities above
    ``min_population`` are kept; for a repeated id the last feature wins (document path,
    then position). (city_id, name, population, lon, lat, feature, feature_text); the
    text is the whole feature, fields that the jobs do not know included."""
    f = _flat(features)
    checked = F.when(F.coalesce(F.col("geoname_id").rlike(_U64), F.lit(False)) & F.col("population").isNotNull(),
                     F.col("population")).otherwise(F.raise_error(F.lit("feature without a numeric geoname_id or population")))
    rows = f.withColumn("population", checked).where(F.col("population") > min_population)
    order = F.struct("doc", "pos")
    typed = F.struct(
        F.col("feature.type").alias("type"),
        F.struct(F.col("feature.properties.geoname_id").alias("geoname_id"),
                 F.col("name"), F.col("population")).alias("properties"),
        F.col("feature.geometry").alias("geometry"))
    return (rows.withColumn("city_id", F.col("geoname_id").cast("long")).withColumn("feature", typed)
            .groupBy("city_id")
            .agg(F.max_by(F.struct("name", "population", "lon", "lat", "feature", F.col("text").alias("feature_text")),
                          order).alias("c"))
            .select("city_id", "c.name", "c.population", "c.lon", "c.lat", "c.feature", "c.feature_text"))
