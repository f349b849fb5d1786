"""Tolerant and strict JSON decoding, GeoJSON lenient/strict reading."""

import pytest
from pyspark.sql import functions as F

from floodflow import schemas
from floodflow.sources import codecs, geojson


def test_tolerant_decode_drops_bad_records(spark):
    texts = [
        ('{"refugees": 5, "city_id": 3, "change": 1, "extra": "ignored"}',),
        ('{"refugees": 5, ',), ('{"city_id": 3}',), ('{"refugees": -1}',),
        ('{"refugees": 7}',), ('{"refugees": "x"}',), ('',), (None,),
        ('{"refugees": 4, "city_id": "5"}',), ('{"refugees": 2, "change": null}',),
    ]
    df = spark.createDataFrame(texts, "value string")
    got = sorted(tuple(r) for r in codecs.decode_tolerant(df, "value").collect())
    assert got == [(2, None, None), (5, 3, 1), (7, None, None)]


def test_strict_decode_fails_on_bad_record(spark):
    df = spark.createDataFrame([('{"timestamp": 1, "city_id": 2',)], "value string")
    with pytest.raises(Exception):
        df.select(codecs.decode_strict("value", schemas.EVENT)).collect()


@pytest.mark.parametrize("text", ['{"city_id": 1}', '{"timestamp": 1, "city_id": 2, "city_name": "a"}',
                                  '{"timestamp": 1, "city_id": null, "city_name": "a", "refugees": 3}'])
def test_strict_decode_fails_without_a_number(spark, text):
    df = spark.createDataFrame([(text,)], "value string")
    with pytest.raises(Exception, match="record without"):
        df.select(codecs.decode_strict("value", schemas.EVENT)).collect()


def test_encode_keeps_nulls(spark):
    df = spark.createDataFrame([(3, None)], "count long, change long")
    assert df.select(codecs.encode_json("count", "change")).first()[0] == '{"count":3,"change":null}'


def _features(spark, rows, path, per_file=None):
    df = spark.createDataFrame(rows, "k long, version int, gid string, name string, pop long")
    feats = df.select("k", "version", geojson.feature_json(
        F.col("gid"), F.col("name"), F.col("pop"), F.lit(1.5), F.lit(2.5)).alias("feature"))
    old = geojson.FEATURES_PER_FILE
    if per_file:
        geojson.FEATURES_PER_FILE = per_file
    try:
        geojson.write_collections(feats, path, ["k", "version"])
    finally:
        geojson.FEATURES_PER_FILE = old
    return geojson.read_features(spark, path)


def test_lenient_skips_and_strict_last_wins(spark, tmp_path):
    rows = [(1, 0, "1", "A", 500000), (2, 0, "2", "B", None), (3, 0, "3", "C", 100),
            (4, 0, "4", "D", 900000), (4, 1, "4", "D2", 800000), (5, 0, "5", "E", 700000),
            (5, 1, "5", "E2", 10)]
    f = _features(spark, rows, str(tmp_path / "g"), per_file=2)
    assert f.count() == len(rows)  # several documents, none lost
    lenient = sorted((r.city_id, r.name) for r in geojson.cities_lenient(f).collect())
    assert lenient == [(1, "A"), (4, "D"), (4, "D2"), (5, "E")]
    with pytest.raises(Exception):
        geojson.cities_strict(f).collect()  # feature 2 has no population
    f2 = _features(spark, [r for r in rows if r[4] is not None], str(tmp_path / "h"), per_file=2)
    strict = sorted((r.city_id, r.name) for r in geojson.cities_strict(f2).collect())
    # last wins among cities above 400,000: D2 replaces D, E stays (E2 too small)
    assert strict == [(1, "A"), (4, "D2"), (5, "E")]


def test_hot_key_spans_documents_and_last_wins(spark, tmp_path):
    # One id holds most features: it is spread over several small documents,
    # and the last copy still wins.
    rows = [(1, v, "1", f"N{v}", 500000 + v) for v in range(12)] + [(2, 0, "2", "B", 600000)]
    path = str(tmp_path / "hot")
    f = _features(spark, rows, path, per_file=3)
    assert f.select("doc").distinct().count() >= 3
    strict = sorted((r.city_id, r.name, r.population) for r in geojson.cities_strict(f).collect())
    assert strict == [(1, "N11", 500011), (2, "B", 600000)]
