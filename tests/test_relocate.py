"""Relocation semantics on small hand-written frames (ties, empty sides,
missing elevation, rounding, names)."""

import re

import pytest
from pyspark.sql import functions as F

from floodflow.plans import relocate

NODE = "id long, tags map<string,string>, lat double, lon double"
ELEV = "lat double, lon double, elevation int"


def place(i, kind, pop, lat, lon, name=None):
    tags = {"place": kind, "population": pop}
    if name is not None:
        tags["name"] = name
    return (i, tags, lat, lon)


def harbour(i, lat, lon):
    return (i, {"harbour": "yes"}, lat, lon)


def run(spark, nodes, elev, level=10.0, size=1.0):
    n = spark.createDataFrame(nodes, NODE)
    e = spark.createDataFrame(elev, ELEV)
    st = relocate.stages(n, e, level, size)
    rows = relocate.relocation_rows(st)
    rel = sorted(tuple(r) for r in relocate.relocations_from(st, rows).collect())
    dst = sorted(tuple(r) for r in relocate.destinations_from(st, rows).collect())
    return rel, dst


HIGH = [(0.5, 5.5, 50), (0.5, 2.5, 50), (0.5, 0.5, 50), (3.5, 3.5, 50)]


def test_whole_move_and_harbour_split(spark):
    nodes = [
        place(1, "town", "100", 0.5, 3.5, "Low"),         # cell (0,3): no data -> relocates
        place(2, "city", "1000", 0.5, 5.5, "High"),       # safe city
        place(3, "village", "10", 0.5, 0.5, "Low2"),      # safe cell, stays
        harbour(50, 0.5, 3.7),                           # nearer than the city
        place(4, "town", "6", 3.5, 0.5, "Far"),           # no data, harbour farther
        place(5, "city", "500", 3.5, 3.5, "Second"),      # safe city
    ]
    rel, dst = run(spark, nodes, HIGH)
    # 100 * 0.75 = 75 to High, 25 to the harbour; 6 -> nearest city Second (whole)
    assert rel == [("Far", 6, "Second"), ("Low", 25, "Waterworld"), ("Low", 75, "High")]
    assert dst == [("High", 1000, 1075), ("Second", 500, 506), ("Waterworld", 0, 25)]


def test_rounding_parts_may_add_one(spark):
    # population 2: 1.5 -> 2 and 0.5 -> 1 (both half-up): 3 people in total.
    nodes = [place(1, "town", "2", 0.5, 3.5, "P"), place(2, "city", "10", 0.5, 5.5, "C"),
             harbour(9, 0.5, 3.6)]
    rel, _ = run(spark, nodes, HIGH)
    assert sorted(n for _, n, _ in rel) == [1, 2]


def test_ties_keep_all_rows(spark):
    # Two cities at equal distance, and two harbours at one point.
    nodes = [place(1, "town", "40", 0.5, 3.5, "P"),
             place(2, "city", "10", 0.5, 5.5, "East"), place(3, "city", "10", 0.5, 1.5, "West"),
             harbour(8, 0.5, 3.4), harbour(9, 0.5, 3.4)]
    elev = HIGH + [(0.5, 1.5, 50)]
    rel, dst = run(spark, nodes, elev)
    # 2 cities x 2 harbours = 4 combined rows, each split in 30 + 10.
    assert sorted(rel) == sorted([("P", 30, "East"), ("P", 30, "West")] * 2 + [("P", 10, "Waterworld")] * 4)
    assert ("Waterworld", 0, 40) in dst


def test_ties_are_repeated_last(spark):
    """Names, shares and gaps are settled before a row is repeated for its harbours."""
    nodes = [place(1, "town", "40", 0.5, 3.5), place(2, "city", "10", 0.5, 5.5, "East"), place(3, "city", "10", 0.5, 1.5, "West"),
             place(4, "town", "8", 3.5, 0.5, "Far"), *[harbour(50 + i, 0.5, 3.4) for i in range(3)]]
    got = relocate.relocations(spark.createDataFrame(nodes, NODE), spark.createDataFrame([*HIGH, (0.5, 1.5, 50)], ELEV), 10.0, 1.0)
    assert sorted(map(tuple, got.collect())) == sorted(
        ([("Waterworld", 30, "East"), ("Waterworld", 30, "West")] + [("Waterworld", 10, "Waterworld")] * 2 + [("Far", 8, "West")]) * 3)
    steps = re.findall(r"Generate (?:explode\(array_repeat|inline)", got._jdf.queryExecution().optimizedPlan().toString())
    assert [s.rpartition(" ")[2] for s in steps] == ["explode(array_repeat"] * 2 + ["inline"]


def test_no_harbour_means_empty(spark):
    nodes = [place(1, "town", "40", 0.5, 3.5, "P"), place(2, "city", "10", 0.5, 5.5, "C")]
    rel, dst = run(spark, nodes, HIGH)
    assert rel == [] and dst == []


def test_no_safe_city_means_empty(spark):
    nodes = [place(1, "town", "40", 0.5, 3.5, "P"), harbour(9, 0.5, 3.6)]
    rel, dst = run(spark, nodes, HIGH)
    assert rel == [] and dst == []


def test_city_without_elevation_is_not_safe(spark):
    nodes = [place(1, "town", "40", 0.5, 3.5, "P"), place(2, "city", "10", 0.5, 3.6, "NoData"),
             place(3, "city", "10", 0.5, 5.5, "Safe"), harbour(9, 3.5, 3.5)]
    rel, _ = run(spark, nodes, HIGH)
    # NoData relocates itself, both go to Safe.
    assert sorted(rel) == [("NoData", 10, "Safe"), ("P", 40, "Safe")]


def test_names_and_tolerant_population(spark):
    nodes = [place(1, "town", " 12 ", 0.5, 3.5), place(2, "city", "1,000", 0.5, 5.5),
             place(3, "hamlet", "12.7", 0.6, 3.5, "H"), place(4, "town", "x", 0.7, 3.5, "X"),
             harbour(9, 3.5, 3.5)]
    rel, dst = run(spark, nodes, HIGH)
    # unnamed place and unnamed city are both "Waterworld"; '1,000' -> null
    # population -> old population 0; 'x' -> null evacuees, kept.
    assert ("Waterworld", 12, "Waterworld") in rel
    assert ("H", 12, "Waterworld") in rel
    assert ("X", None, "Waterworld") in rel
    assert dst == [("Waterworld", 0, 24)]


def test_node_both_place_and_harbour(spark):
    both = (7, {"place": "town", "population": "8", "name": "Port", "harbour": "yes"}, 0.5, 3.5)
    nodes = [both, place(2, "city", "10", 0.5, 5.5, "C")]
    rel, _ = run(spark, nodes, HIGH)
    # Its own harbour is at distance 0 < city distance: split 6 + 2.
    assert sorted(rel) == [("Port", 2, "Waterworld"), ("Port", 6, "C")]


def test_split_null_predicate_in_neither_part(spark):
    from floodflow.operators.relational import split
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "id long, d double")
    a, b = split(df, F.col("d") < 2)
    assert [r.id for r in a.collect()] == [1] and [r.id for r in b.collect()] == [3]


def test_bounded_scan_pushes_box_to_parquet(spark, tmp_path):
    e = spark.createDataFrame(HIGH + [(80.5, 100.5, 3)], ELEV)
    e.write.parquet(str(tmp_path / "e"))
    from floodflow.sources.files import read_elevation
    places = relocate.all_places(relocate.filter_nodes(
        spark.createDataFrame([place(1, "town", "1", 0.5, 2.7, "P")], NODE)), 1.0)
    b = relocate.bounded_elevation(read_elevation(spark, str(tmp_path / "e")), places, 1.0)
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lat), IsNotNull(lon), GreaterThanOrEqual(lat" in plan
    # Only raster points in cells that hold a place survive.
    assert sorted((r.lat, r.lon) for r in b.collect()) == [(0.5, 2.5)]


def test_pluggable_cell_function_gives_same_result(spark):
    # A single string key equivalent to the square grid, passed as cell_fn.
    def cell_fn(lat, lon):
        return F.concat_ws(":", F.floor(lat / F.lit(1.0)).cast("string"),
                           F.floor(lon / F.lit(1.0)).cast("string"))
    nodes = [place(1, "town", "100", 0.5, 3.5, "Low"), place(2, "city", "1000", 0.5, 5.5, "High"),
             place(3, "village", "10", 0.5, 0.5, "Low2"), harbour(50, 0.5, 3.7),
             place(4, "town", "6", 3.5, 0.5, "Far"), place(5, "city", "500", 3.5, 3.5, "Second")]
    n = spark.createDataFrame(nodes, NODE)
    e = spark.createDataFrame(HIGH, ELEV)
    grid = sorted(tuple(r) for r in relocate.relocations(n, e, 10.0, 1.0).collect())
    custom = sorted(tuple(r) for r in relocate.relocations(n, e, 10.0, 1.0, cell_fn=cell_fn).collect())
    assert custom == grid and len(grid) == 3


def test_fill_nulls_subset(spark):
    from floodflow.operators.relational import fill_nulls
    df = spark.createDataFrame([(None, None, None)], "a long, s string, t string")
    assert tuple(fill_nulls(df).first()) == (0, "Waterworld", "Waterworld")
    assert tuple(fill_nulls(df, text_subset=["t"]).first()) == (0, None, "Waterworld")


def test_bounded_elevation_is_the_same_under_any_broadcast_bound(spark):
    from floodflow.plans import relocate as R
    from floodflow.functions.columns import with_cell
    raster = spark.range(400).selectExpr("(id % 20) * 0.4 AS lat", "floor(id / 20) * 0.4 AS lon",
                                         "cast(id AS double) AS elevation")
    places = with_cell(spark.createDataFrame([(0.1, 0.1), (7.0, 7.0)], "lat double, lon double"), size=0.5)
    got = [sorted(tuple(r) for r in R.bounded_elevation(raster, places, 0.5, n).collect()) for n in (0, 1000)]
    assert got[0] == got[1] and 0 < len(got[0]) < 20


@pytest.mark.parametrize("piece", [1, 7, 100_000])
def test_ties_are_counted_and_written_out_last(spark, monkeypatch, piece):
    monkeypatch.setattr(relocate, "PIECE_ROWS", piece)
    monkeypatch.setattr(relocate, "TASK_ROWS", 50)
    nodes = [place(1, "town", "41", 0.5, 3.5, "P"), place(2, "town", "10", 0.5, 6.9, "Q")]
    nodes += [place(100 + i, "city", "10", 0.5, 5.5, f"C{i}") for i in range(12)]
    nodes += [harbour(500 + i, 0.5, 3.4) for i in range(25)]
    st = relocate.stages(spark.createDataFrame(nodes, NODE), spark.createDataFrame(HIGH, ELEV), 10.0, 1.0)
    moves = relocate.moves(st)
    assert sorted((r.id, r.cities, r.harbours) for r in moves.collect()) == [(1, 12, 25), (2, 12, 25)]
    rows = relocate.relocation_rows(st)
    want = {(1, 31, 100 + i): 25 for i in range(12)} | {(2, 10, 100 + i): 25 for i in range(12)} | {(1, 10, -1): 300}
    assert {tuple(r)[:3]: r["count"] for r in rows.groupBy("id", "num_evacuees", "destinationId").count().collect()} == want
    # Nothing is dealt by a row's own columns once the ties are written out.
    named = relocate.named_relocations(st, moves)
    assert sorted(map(tuple, named.collect()), key=str) == sorted(map(tuple, relocate.relocations_from(st, rows).collect()), key=str)
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "SortMergeJoin" not in plan
    totals = rows.groupBy("destinationId").agg(F.sum("num_evacuees").alias("arrivals"))
    assert sorted(map(tuple, relocate.arrivals(st, moves).collect())) == sorted(map(tuple, totals.collect()))


def test_cities_beyond_the_broadcast_bound_give_the_same_pairs(spark, monkeypatch):
    from floodflow.operators import nearest
    monkeypatch.setattr(nearest, "SALT_ROWS", 3)
    right = spark.createDataFrame([(i, 1.0, 2.0 + i % 2) for i in range(10)], "r long, lat double, lon double")
    left = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 9.0)], "k string, rlat double, rlon double")
    got = [sorted((r.k, r.r) for r in nearest.at_locations(left, right, broadcast_bytes=n).collect()) for n in (0, 1 << 20)]
    assert got[0] == got[1] == [("a", i) for i in range(0, 10, 2)] + [("b", i) for i in range(1, 10, 2)]


def test_sink_writes_the_rows_without_a_copy_of_them(spark, tmp_path):
    import os
    nodes = [place(1, "town", "41", 0.5, 3.5, "P"), place(2, "city", "10", 0.5, 5.5, "East"),
             place(3, "city", "10", 0.5, 1.5, "West"), harbour(8, 0.5, 3.4), harbour(9, 0.5, 3.4)]
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(HIGH + [(0.5, 1.5, 50)], ELEV)
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = {d for d in os.listdir(shared) if d.startswith("rdd-")}
    rel, dst = relocate.run(n, e, 10.0, str(tmp_path / "out"), 1.0)
    assert {d for d in os.listdir(shared) if d.startswith("rdd-")} <= before
    want_rel, want_dst = run(spark, nodes, HIGH + [(0.5, 1.5, 50)])
    assert sorted(map(tuple, spark.read.orc(rel).collect())) == want_rel and len(want_rel) == 8
    assert sorted(map(tuple, spark.read.orc(dst).collect())) == want_dst
