"""Scalar column expressions. All are built-in Spark expressions, so they stay
inside whole-stage code generation; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The relocation split and the map display rules.
CITY_SHARE = 0.75
HARBOUR_SHARE = 0.25
RADIUS_BASE = 7.0
RADIUS_SCALE = 7.0
FILL_OPACITY_ACTIVE = 0.5
BIG_CITY_POPULATION = 400_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sq_distance(lat: Column | str, lon: Column | str,
                lat2: Column | str, lon2: Column | str) -> Column:
    """Planar squared distance in degrees, no square root and no wrap.

    Operand order is fixed, (lat2 - lat)^2 + (lon2 - lon)^2, so that every
    engine gets the same IEEE value and equal distances tie exactly."""
    dlat = _c(lat2) - _c(lat)
    dlon = _c(lon2) - _c(lon)
    return dlat * dlat + dlon * dlon


def cell_of(coord: Column | str, size: float) -> Column:
    """Index of the grid row/column holding ``coord`` for square cells."""
    return F.floor(_c(coord) / F.lit(float(size))).cast("long")


def with_cell(df: DataFrame, lat: str = "lat", lon: str = "lon", size: float = 0.5,
              names: tuple[str, str] = ("cy", "cx"), cell_fn=None) -> DataFrame:
    """Add a spatial cell key. Default is a square grid of ``size`` degrees.

    ``cell_fn(lat_col, lon_col) -> Column`` replaces the grid with any other
    cell function (for example a vectorised hexagon indexer); it then fills a
    single column named ``names[0]``."""
    if cell_fn is not None:
        return df.withColumn(names[0], cell_fn(F.col(lat), F.col(lon)))
    return (df.withColumn(names[0], cell_of(lat, size))
              .withColumn(names[1], cell_of(lon, size)))


_WS = r"^[\x00-\x20]+|[\x00-\x20]+$"
_NUMERIC = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]*)$"
_INT_PREFIX = r"^[+-]?[0-9]*"


def tolerant_long(c: Column | str) -> Column:
    """String to long as a non-ANSI cast does it: surrounding control
    characters and blanks are ignored, a fraction is truncated, anything else
    ('1,000', '1e3', '') is null. Overflow is null as well."""
    t = F.regexp_replace(_c(c), _WS, "")
    ip = F.regexp_extract(t, _INT_PREFIX, 0)
    return (F.when(~t.rlike(_NUMERIC), F.lit(None).cast("long"))
             .when(ip.isin("", "+", "-"), F.lit(0).cast("long"))
             .otherwise(ip.try_cast("long")))


def sampling_weight(pop: Column | str) -> Column:
    """population * floor(sqrt(population)), as a long."""
    p = _c(pop).cast("long")
    return p * F.floor(F.sqrt(p.cast("double"))).cast("long")


def change_ratio(change: Column | str, count: Column | str) -> Column:
    """change / count; 0 when change is null or 0 (and when count is 0)."""
    ch, cn = _c(change), _c(count)
    return (F.when(ch.isNull() | (ch == 0), F.lit(0.0))
             .otherwise(F.coalesce(F.try_divide(ch.cast("double"), cn.cast("double")),
                                   F.lit(0.0))))


def map_style(share: Column | str, ratio: Column | str) -> dict[str, Column]:
    """Marker radius and fill opacity for the dashboard table."""
    r = _c(ratio)
    return {
        "radius": F.lit(RADIUS_BASE) + _c(share) * F.lit(RADIUS_SCALE),
        "fill_opacity": F.when(r == 0, F.lit(0.0)).otherwise(F.lit(FILL_OPACITY_ACTIVE)),
    }
