"""Scans and sinks: declared schemas, pushdown, sink modes, run keys."""

import pytest
from pyspark.sql import functions as F

from floodflow import schemas
from floodflow.operators.relational import cached
from floodflow.plans import relocate
from floodflow.sources import files, tables

SF = "/root/testdata/sf0.001"


def test_orc_round_trip_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "nodes")
    files.write_orc(tables.nodes(spark, SF), path)
    n = files.read_nodes(spark, path)
    assert n.schema == schemas.NODES
    q = n.where(F.col("lat") > 50).select("id")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lat), GreaterThan(lat,50.0)]" in plan
    assert q.count() == tables.nodes(spark, SF).where(F.col("lat") > 50).count()


def test_normalised_nodes_push_tag_filters(spark, tmp_path):
    path = str(tmp_path / "norm")
    relocate.normalise_nodes(relocate.filter_nodes(tables.nodes(spark, SF))).write.parquet(path)
    q = spark.read.parquet(path).where(F.col("place") == "city")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(place,city)" in plan


def test_orc_sink_refuses_to_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1, "b")], schemas.RELOCATIONS)
    files.write_orc(df, path)
    with pytest.raises(Exception):
        files.write_orc(df, path)
    assert files.read_orc(spark, path, schemas.RELOCATIONS).count() == 1


def test_run_keys_are_unique():
    assert len({files.run_key() for _ in range(1000)}) == 1000


def test_cached_releases(spark):
    df = spark.range(10)
    with cached(df) as d:
        assert d.is_cached and d.count() == 10
    assert not df.is_cached


@pytest.mark.parametrize("kind", ["parquet", "orc"])
def test_skipped_files_are_accounted_for(spark, tmp_path, kind):
    from floodflow import schemas
    from floodflow.sources import files
    folder = tmp_path / "e"
    df = spark.range(40).selectExpr("double(id) AS lat", "double(id) AS lon", "int(id) AS elevation").repartition(4)
    getattr(df.write, kind)(str(folder))
    whole = sorted(folder.glob(f"part-*.{kind}"))
    torn = folder / f"part-99999-torn.{kind}"
    torn.write_bytes(whole[0].read_bytes()[:-40])
    read = files.read_parquet if kind == "parquet" else files.read_orc
    assert read(spark, str(folder), schemas.ELEVATION, ignore_corrupt=True).count() == 40
    lost = files.unread_files(spark, str(folder), schemas.ELEVATION, kind).collect()
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in lost] == [(torn.name, torn.stat().st_size)]
    with pytest.raises(Exception):
        read(spark, str(folder), schemas.ELEVATION).count()
