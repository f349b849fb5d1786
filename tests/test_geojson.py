"""GeoJSON: types checked, whole features kept, one huge document read by many tasks."""

import json

import pytest
from pyspark.sql import functions as F

from floodflow.plans import snapshot
from floodflow.sources import geojson


def feature(gid="1", name="A", population=500000, geometry=None, **more):
    return {"type": "Feature", "properties": {"geoname_id": gid, "name": name, "population": population, **more},
            "geometry": geometry or {"type": "Point", "coordinates": [4.5, 52.25]}, "id": 7}


def write(path, features, kind="FeatureCollection"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"type": kind, "features": features}, separators=(",", ":"), ensure_ascii=False))
    return str(path)


@pytest.fixture(params=["documents", "split"])
def read(request, spark):
    return lambda path: (geojson.read_features if request.param == "documents" else geojson.split_features)(spark, path)


def test_lenient_skips_other_types(tmp_path, read):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    path = write(tmp_path / "c.json", [
        feature("1"), feature("2", population="900000"), feature("3", population=-5), feature("4", population=1.5),
        feature("5", name=7), feature(6), feature("7", population=None), feature("8", geometry=square), feature("9", population=3)])
    got = sorted(tuple(r) for r in geojson.cities_lenient(read(path)).collect())
    assert got == [(1, "A", 500000, 4.5, 52.25), (8, "A", 500000, None, None)]


@pytest.mark.parametrize("bad", [feature("x", population=1), feature("1", population="500000"), feature(5, population=1),
                                 {"type": "Feature", "properties": {}, "geometry": None}, feature("2", population=-1)])
def test_strict_fails_on_any_bad_feature(tmp_path, read, bad):
    # The bad ones would not pass the population filter: they fail all the same.
    with pytest.raises(Exception):
        geojson.cities_strict(read(write(tmp_path / "c.json", [feature("3"), bad]))).collect()


def test_other_documents_are_refused(tmp_path, read):
    with pytest.raises(Exception):
        read(write(tmp_path / "c.json", [feature()], kind="Topology")).collect()
    (tmp_path / "f.json").write_text(json.dumps({"type": "GeometryCollection", "geometries": []}))
    with pytest.raises(Exception):
        read(str(tmp_path / "f.json")).collect()


def test_whole_feature_goes_out(spark, tmp_path, read):
    path = write(tmp_path / "c.json", [feature("1", "Ünï", 500000, country={"code": "NL", "tags": [1, "x"]}), feature("1", "last", 600000, extra=True)])
    cities = geojson.cities_strict(read(path))
    updates = spark.createDataFrame([(1, 5, None), (2, 3, 1)], "city_id long, refugees long, change long")
    events = [json.loads(r[0]) for r in snapshot.enrich_updates(updates, cities).select(snapshot.encode_event(whole=True)).collect()]
    assert sorted(events, key=lambda e: e["count"]) == [
        {"count": 3, "feature": None, "change": 1}, {"count": 5, "feature": feature("1", "last", 600000, extra=True), "change": None}]


def test_one_huge_document_is_read_by_many_tasks(spark, tmp_path):
    n = 200_000
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for i in range(n):
            f.write(("," if i else "") + '{"type":"Feature","properties":{"geoname_id":"%d","name":"N%d","population":%d},'
                    '"geometry":{"type":"Point","coordinates":[1.5,2.5]}}' % (i % 50, i, 400000 + i))
        f.write("]}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        rows = geojson.split_features(spark, str(tmp_path / "big.json"))
        tasks = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(tasks) >= 15 and sum(r["count"] for r in tasks) == n
        got = {r.city_id: r.name for r in geojson.cities_strict(rows).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # Of each id the last in the document wins, whichever task read it.
    assert got == {i: f"N{n - 50 + i}" for i in range(50)}


def test_a_mark_inside_a_feature_fails_loudly(spark, tmp_path):
    path = write(tmp_path / "c.json", [feature("1", note={"type": "Feature", "x": 1})])
    assert geojson.read_features(spark, path).count() == 1
    with pytest.raises(Exception):
        geojson.split_features(spark, path).collect()


def _bytes_read(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_a_document_is_read_once_and_its_texts_are_exact(spark, tmp_path):
    odd = [' { "type" : "Feature",\n "geometry":{"type":"Point","coordinates":[4.50, 5.225e1]},'
           '"properties":{"geoname_id":"%d","name":"\\u00dcn\u00ef","population":500000.0}}' % i for i in range(3000)]
    text = '\n{ "features": [' + ",".join(odd) + '],"type":"FeatureCollection"}\n'
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    before = _bytes_read(spark)
    got = geojson.read_features(spark, str(tmp_path)).select("pos", "text").collect()
    assert _bytes_read(spark) - before < 3 * len(text.encode())
    assert [r.text for r in sorted(got, key=lambda r: r.pos)] == [o.strip() for o in odd]
