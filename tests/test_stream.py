"""Windowed totals: batch plan and keyed-state stream."""

import datetime as dt

from pyspark.sql import functions as F

from floodflow.plans import totals

EV = "ts timestamp_ntz, event_id long, city_id long, city_name string, refugees long"


def t(h, m=0, s=0):
    return dt.datetime(2024, 1, 1, h, m, s)


def test_running_total_and_change_of_a_window(spark):
    ev = spark.createDataFrame([
        (t(0, 5), 1, 40, "Alder", 500), (t(1, 10), 2, 40, "Alder", 30), (t(1, 20), 3, 40, "Alder", 12),
        (t(1, 25), 4, 40, "Alder", 3), (t(1, 30), 5, 41, "Birch", 0)], EV)
    rows = {(r.city_id, r.window_start.hour): (r.refugees, r.change)
            for r in totals.dense_window_totals(ev, "1 hour").collect()}
    assert rows[(40, 1)] == (545, 45)
    assert rows[(41, 1)] == (0, 0)


def test_quiet_windows_zero_and_first_name_kept(spark):
    ev = spark.createDataFrame([
        (t(0, 1), 1, 1, "A", 5), (t(0, 2), 2, 2, "B", 3), (t(3, 0), 3, 1, "A-later", 4)], EV)
    got = sorted((r.city_id, r.city_name, r.window_start.hour, r.refugees, r.change)
                 for r in totals.dense_window_totals(ev, "1 hour").collect())
    assert got == [(1, "A", 0, 5, 5), (1, "A", 1, 5, 0), (1, "A", 2, 5, 0), (1, "A", 3, 9, 4),
                   (2, "B", 0, 3, 3), (2, "B", 1, 3, 0), (2, "B", 2, 3, 0), (2, "B", 3, 3, 0)]


def test_hot_city_preaggregates_before_shuffle(spark):
    ev = spark.range(2000).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("city_id"),
        F.lit("x").alias("city_name"), F.lit(1).cast("long").alias("refugees"))
    pw = totals.per_window(ev, totals.window_us("1 hour"))
    plan = pw._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan  # map-side combine before the exchange
    df = totals.dense_window_totals(ev, "1 hour")
    hot = [r for r in df.where("city_id = 1").collect()]
    assert sum(r.change for r in hot) == 667 + 1  # every third event plus id 1


def test_stream_equals_batch(spark, tmp_path):
    from floodflow.sources import tables
    from floodflow.streaming import runner
    ev = tables.city_events(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "events")
    runner.write_event_files(ev, path, slices=3)
    got = sorted(tuple(r) for r in runner.run_files(spark, path, 3600, files_per_trigger=1).collect())
    want = sorted(tuple(r) for r in totals.dense_window_totals(ev, "1 hour", closed_only=True).collect())
    assert got == want and len(got) > 0


def test_one_city_with_a_million_windows(spark):
    # Two events a million hours apart: no array or window partition may hold them all.
    far = t(0) + dt.timedelta(hours=1_000_000)
    ev = spark.createDataFrame([(t(0, 5), 1, 1, "A", 5), (t(0) + dt.timedelta(hours=700), 2, 1, "A", 2),
                                (far, 3, 1, "A", 1), (far, 4, 2, "B", 9)], EV)
    df = totals.dense_window_totals(ev, "1 hour")
    got = df.groupBy("city_id").agg(F.count("*").alias("n"), F.sum("change").alias("c"), F.max("refugees").alias("r"),
                                    F.count(F.when(F.col("refugees") == 5, 1)).alias("early")).collect()
    assert {(r.city_id, r.n, r.c, r.r, r.early) for r in got} == {(1, 1_000_001, 8, 8, 700), (2, 1, 9, 9, 0)}
    size = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert size < 600_000  # one city is shared by several tasks


def test_blocks_of_windows_equal_one_sum(spark, monkeypatch):
    from floodflow.sources import tables
    ev = tables.city_events(spark, "/root/testdata/sf0.001")
    want = sorted(map(tuple, totals.dense_window_totals(ev, "1 hour").collect()))
    monkeypatch.setattr(totals, "BLOCK", 3)
    assert sorted(map(tuple, totals.dense_window_totals(ev, "1 hour").collect())) == want
