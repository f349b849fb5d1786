"""An elevation raster kept in the order of a space-filling curve.

``write_raster`` gives every point the place of its grid cell on a Z-order (Morton)
curve, deals the points out by that key, sorts them, and writes Parquet in folders of
one curve block (``BLOCK_BITS`` bits of each cell number, so a tile of 8 x 8 cells).
Cells near each other are near on the curve, so what a region needs is a few ranges
of keys.

``read_cells`` turns the cells that are wanted into at most ``MAX_RANGES`` such
ranges. They reach the reader twice: as ranges of folders (files of other blocks are
not even listed for the scan) and as pushed filters on the key column, which skip row
groups by their statistics. A semi join then keeps the wanted cells exactly. Nothing
grows with the planet: two islands on two continents read the files of two tiles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodflow import schemas
from floodflow.functions.columns import with_cell
from floodflow.operators.relational import BROADCAST_BYTES, maybe_broadcast

BLOCK_BITS = 3
MAX_RANGES = 128
CELL = ["cy", "cx"]
#: Cell numbers are shifted to be positive: 31 bits each, 62 bits of key.
_SHIFT = 1 << 30
#: Masks and shifts that spread 31 bits to every second bit of 62.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
           (2, 0x3333333333333333), (1, 0x5555555555555555))
STORED = T.StructType([*schemas.ELEVATION.fields, T.StructField("curve", T.LongType()),
                       T.StructField("block", T.LongType())])


def curve_key(cy: str = "cy", cx: str = "cx") -> Column:
    """Place of a cell on the curve; cells from -2**30 to 2**30 - 1, null elsewhere."""

    def spread(c: str) -> Column:
        x = F.col(c) + F.lit(_SHIFT)
        x = F.when((x >= 0) & (x < 2 * _SHIFT), x)
        for by, mask in _SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
        return x

    return F.shiftleft(spread(cy), 1).bitwiseOR(spread(cx))


def block_of(key: Column) -> Column:
    return F.shiftright(key, 2 * BLOCK_BITS)


def write_raster(points: DataFrame, path: str, cell_size: float, files: int | None = None) -> None:
    """Write (lat, lon, elevation) along the curve. Points without coordinates have no
    cell and are not written. ``files`` bounds the number of tasks that write; a block
    with very many points is shared by several of them."""
    rows = with_cell(points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), size=cell_size)
    rows = rows.withColumn("curve", curve_key()).drop(*CELL).where(F.col("curve").isNotNull())
    rows = rows.withColumn("block", block_of(F.col("curve")))
    # The coordinates complete the order, so that one dense cell can be split.
    order = ["block", "curve", "lat", "lon"]
    rows = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    rows.sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("block").parquet(path)


def key_ranges(cells: DataFrame, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of curve keys that hold all ``cells``.

    Keys are grouped by their leading bits, as many as leave at most ``most`` groups
    (sketched counts of all lengths in one job, then checked); a group is the range
    from its first to its last key. Only those ranges reach the driver."""
    keys = cells.select(curve_key().alias("k")).where(F.col("k").isNotNull())
    lengths = [*range(0, 62, 6), 62]  # without any of its 62 bits, every key is in one group
    sketch = keys.agg(*[F.approx_count_distinct(F.shiftright("k", s), 0.02).alias(str(s)) for s in lengths]).first()
    for s in lengths:
        if sketch[str(s)] > most * 1.05:
            continue
        rows = (keys.groupBy(F.shiftright("k", s).alias("g")).agg(F.min("k").alias("a"), F.max("k").alias("b"))
                .limit(most + 1).collect())
        if len(rows) <= most:
            ranges: list[tuple[int, int]] = []
            for a, b in sorted((r["a"], r["b"]) for r in rows):
                if ranges and a <= ranges[-1][1] + 1:
                    ranges[-1] = (ranges[-1][0], b)
                else:
                    ranges.append((a, b))
            return ranges
    raise AssertionError("one group holds all keys")


def read_cells(spark: SparkSession, path: str, cells: DataFrame, cell_size: float,
               most: int = MAX_RANGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lat, lon, elevation) of the stored points in the wanted cells (cy, cx).
    ``cell_size`` must be the one the raster was written with."""
    ranges = key_ranges(cells, most)
    stored = spark.read.schema(STORED).parquet(path)
    if not ranges:
        return stored.select(*schemas.ELEVATION.names).where(F.lit(False))

    def either(tests: list[Column]) -> Column:
        return reduce(lambda x, y: x | y, tests)

    blocks = sorted({(a >> 2 * BLOCK_BITS, b >> 2 * BLOCK_BITS) for a, b in ranges})
    near = stored.where(either([F.col("block").between(a, b) for a, b in blocks])) \
        .where(either([F.col("curve").between(a, b) for a, b in ranges]))
    wanted = maybe_broadcast(cells.select(*CELL).distinct(), broadcast_bytes)
    return with_cell(near, size=cell_size).join(wanted, CELL, "left_semi").select(*schemas.ELEVATION.names)
