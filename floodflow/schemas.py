"""Declared schemas (never inferred) for inputs, outputs and streams."""

from pyspark.sql import types as T

REF = T.StructType([T.StructField("ref", T.LongType())])
MEMBER = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("ref", T.LongType()),
    T.StructField("role", T.StringType()),
])

# Map nodes: 13 columns, all nullable; only id, tags, lat, lon are used.
NODES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("nds", T.ArrayType(REF)),
    T.StructField("members", T.ArrayType(MEMBER)),
    T.StructField("changeset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("uid", T.LongType()),
    T.StructField("user", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("visible", T.BooleanType()),
])

# Elevation raster points.
ELEVATION = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("elevation", T.IntegerType()),
])

RELOCATIONS = T.StructType([
    T.StructField("place", T.StringType()),
    T.StructField("num_evacuees", T.LongType()),
    T.StructField("destination", T.StringType()),
])

DESTINATIONS = T.StructType([
    T.StructField("destination", T.StringType()),
    T.StructField("old_population", T.LongType()),
    T.StructField("new_population", T.LongType()),
])

# Stream input event: epoch milliseconds, city, refugees in this event.
EVENT = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("city_id", T.LongType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("refugees", T.LongType()),
])

# Stream output update: running total and the change of the closed window.
UPDATE = T.StructType([
    T.StructField("city_id", T.LongType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("refugees", T.LongType()),
    T.StructField("change", T.LongType()),
])

# Update as the map side reads it: only refugees is required.
UPDATE_AS_READ = T.StructType([
    T.StructField("refugees", T.LongType()),
    T.StructField("city_id", T.LongType()),
    T.StructField("change", T.LongType()),
])

# Properties are read as raw text and checked afterwards, so that one bad
# feature does not turn its whole document into a corrupt record.
GEO_PROPERTIES = T.StructType([
    T.StructField("geoname_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("population", T.StringType()),
])
GEO_GEOMETRY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("coordinates", T.ArrayType(T.DoubleType())),
])
GEO_FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", GEO_PROPERTIES),
    T.StructField("geometry", GEO_GEOMETRY),
])
GEO_COLLECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(GEO_FEATURE)),
])
