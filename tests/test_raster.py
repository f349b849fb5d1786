"""The raster along the curve: keys, ranges, what a read touches, and results."""

import random

import pytest
from pyspark.sql import functions as F

from floodflow.plans import relocate
from floodflow.sources import raster, tables

SF = "/root/testdata/sf0.001"


def morton(cy, cx):
    y, x, out = cy + (1 << 30), cx + (1 << 30), 0
    for i in range(31):
        out |= (x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1
    return out


def test_keys_interleave_the_bits(spark):
    cells = [(0, 0), (-1, -1), (5, -7), (-(1 << 30), (1 << 30) - 1), ((1 << 30) - 1, -(1 << 30)), (123456, 654321)]
    got = spark.createDataFrame(cells, "cy long, cx long").select("cy", "cx", raster.curve_key().alias("k")).collect()
    assert {(r.cy, r.cx): r.k for r in got} == {c: morton(*c) for c in cells}
    odd = spark.createDataFrame([(1 << 30, 0), (None, 0)], "cy long, cx long")
    assert [r.k for r in odd.select(raster.curve_key().alias("k")).collect()] == [None, None]


@pytest.mark.parametrize("most", [1, 4, 40])
def test_ranges_are_few_and_hold_every_cell(spark, most):
    rnd = random.Random(most)
    cells = [(rnd.randint(-40, 40), rnd.randint(-90, 90)) for _ in range(300)]
    ranges = raster.key_ranges(spark.createDataFrame(cells, "cy long, cx long"), most)
    assert 1 <= len(ranges) <= most
    assert all(any(a <= morton(*c) <= b for a, b in ranges) for c in cells)
    assert ranges == sorted(ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))
    assert raster.key_ranges(spark.createDataFrame([], "cy long, cx long"), most) == []


def planet(spark):
    """A point every half degree, elevations by place."""
    return spark.range(360 * 720).select(
        (F.floor(F.col("id") / 720) / 2.0 - 90 + 0.25).alias("lat"), (F.col("id") % 720 / 2.0 - 180 + 0.25).alias("lon"),
        (F.col("id") % 97).cast("int").alias("elevation"))


def read_files(df):
    """Files the scan opened, from the metrics of the executed plan."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    text, scans = [plan], 0
    while text:
        p = text.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            text.append(p.executedPlan())
            continue
        if hasattr(p, "metrics") and p.metrics().contains("numFiles"):
            scans += p.metrics().apply("numFiles").value()
        kids = p.children()
        text += [kids.apply(i) for i in range(kids.size())]
        if p.nodeName().endswith("QueryStage"):
            text.append(p.plan())
    return scans


def test_two_continents_read_two_tiles(spark, tmp_path):
    path = str(tmp_path / "planet")
    raster.write_raster(planet(spark), path, 0.5, files=16)
    cells = spark.createDataFrame([(104, 9), (105, 9), (-68, 302), (-67, 303)], "cy long, cx long")
    got = raster.read_cells(spark, path, cells, 0.5)
    want = planet(spark).withColumn("cy", F.floor(F.col("lat") / 0.5)).withColumn("cx", F.floor(F.col("lon") / 0.5)) \
        .join(cells, ["cy", "cx"], "left_semi").select("lat", "lon", "elevation")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "curve" in pushed and "PartitionFilters: [((block" in plan.replace("PartitionFilters: [(((", "PartitionFilters: [((")
    everything = len(spark.read.parquet(path).inputFiles())
    assert 1 <= read_files(raster.read_cells(spark, path, cells, 0.5)) <= 4 < everything / 100


def test_dense_cell_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "dense")
    dense = spark.range(20000).select((F.col("id") / 1e6 + 10).alias("lat"), F.lit(10.1).alias("lon"), F.lit(1).alias("elevation"))
    raster.write_raster(dense.unionByName(dense.limit(1).withColumn("lat", F.lit(None).cast("double"))), path, 0.5, files=4)
    df = spark.read.parquet(path)
    assert df.count() == 20000 and len(df.inputFiles()) == 4


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_same_cells_as_the_plain_scan(spark, tmp_path, limit):
    points, path = tables.elevation_points(spark, SF), str(tmp_path / "r")
    raster.write_raster(points, path, tables.CELL_SIZE)
    places = relocate.all_places(relocate.filter_nodes(tables.nodes(spark, SF)), tables.CELL_SIZE)
    got = raster.read_cells(spark, path, places, tables.CELL_SIZE, most=9, broadcast_bytes=limit)
    want = relocate.bounded_elevation(points, places, tables.CELL_SIZE)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0
    none = raster.read_cells(spark, path, places.where("id < -1000000"), tables.CELL_SIZE)
    assert none.count() == 0 and none.columns == ["lat", "lon", "elevation"]


def test_job_on_the_written_raster(spark, tmp_path):
    path = str(tmp_path / "r")
    raster.write_raster(tables.elevation_points(spark, SF), path, tables.CELL_SIZE)
    nodes = tables.nodes(spark, SF)
    st = relocate.stages(nodes, path, tables.SEA_LEVEL, tables.CELL_SIZE)
    plain = relocate.stages(nodes, tables.elevation_points(spark, SF), tables.SEA_LEVEL, tables.CELL_SIZE)
    assert st.to_relocate.exceptAll(plain.to_relocate).isEmpty() and st.to_relocate.count() == plain.to_relocate.count()
