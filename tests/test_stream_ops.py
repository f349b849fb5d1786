"""Stream operations beyond the event-time run: restart with saved state,
wall-clock ticks, streaming enrichment, key/value decoding, corrupt files."""

import time

import pytest
from pyspark.sql import functions as F

from floodflow.plans import totals
from floodflow.sources import codecs, tables
from floodflow.streaming import runner
from floodflow.streaming.windowed import windowed_updates

SF = "/root/testdata/sf0.001"


def test_restart_continues_totals(spark, tmp_path):
    ev = tables.city_events(spark, SF)
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    mid = lo + (hi - lo) / 2
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    runner.write_event_files(ev.where(F.col("ts") < mid), src + "/a", slices=1)
    runner.run_files(spark, src, 3600, out=out, ckpt=ck)
    time.sleep(1.1)  # newer files get newer modification times
    runner.write_event_files(ev.where(F.col("ts") >= mid), src + "/b", slices=1)
    got = sorted(tuple(r) for r in runner.run_files(spark, src, 3600, out=out, ckpt=ck).collect())
    want = sorted(tuple(r) for r in totals.dense_window_totals(ev, "1 hour", closed_only=True).collect())
    assert got == want


def test_wall_clock_ticks_report_every_city(spark, tmp_path):
    src = str(tmp_path / "src")
    now = int(time.time() * 1000)
    spark.createDataFrame([(now, 1, "A", 5, 1), (now, 2, "B", 7, 2), (now, 1, "A2", 1, 3)],
                          "timestamp long, city_id long, city_name string, refugees long, event_id long") \
        .coalesce(1).write.json(src)
    stream = spark.readStream.schema(runner.STREAM_EVENT).json(src)
    q = (windowed_updates(stream, 1, "ProcessingTime").writeStream.format("memory")
         .queryName("ticks").outputMode("append").trigger(processingTime="500 milliseconds").start())
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            time.sleep(1)
            rows = spark.sql("select * from ticks").collect()
            if len({r.window_start for r in rows if r.city_id == 1}) >= 3:
                break
    finally:
        q.stop()
    rows = spark.sql("select * from ticks").collect()
    a = sorted((r.window_start, r.refugees, r.change) for r in rows if r.city_id == 1)
    b = [r for r in rows if r.city_id == 2]
    assert a[0][1:] == (6, 6) and all(x[1:] == (6, 0) for x in a[1:])   # then zeros
    assert {r.city_name for r in rows if r.city_id == 1} == {"A"}          # first name kept
    assert b and max(r.refugees for r in b) == 7


def test_enrich_stream_left_lookup(spark, tmp_path):
    from floodflow.streaming.enrich import enrich_stream
    src = str(tmp_path / "upd")
    spark.createDataFrame([('{"city_id":1,"refugees":5,"change":5}',), ('{"city_id":9,"refugees":2}',),
                           ('{"refugees":3}',), ('broken',)], "value string").write.text(src)
    cities = spark.createDataFrame(
        [(1, ("Feature", ("1", "A", 500000), ("Point", [1.0, 2.0])))],
        "city_id long, feature struct<type:string,properties:struct<geoname_id:string,name:string,population:long>,geometry:struct<type:string,coordinates:array<double>>>")
    stream = spark.readStream.schema("value string").text(src)
    q = (enrich_stream(stream, cities).writeStream.format("memory").queryName("enriched")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    vals = sorted(r.value for r in spark.sql("select * from enriched").collect())
    assert len(vals) == 3
    assert '{"count":2,"feature":null,"change":null}' in vals
    assert any('"name":"A"' in v and '"count":5' in v for v in vals)


def test_events_from_records(spark):
    rec = spark.createDataFrame([("7", '{"timestamp":1,"city_id":7,"city_name":"X","refugees":3}')],
                                "key string, value string")
    assert [tuple(r) for r in codecs.events_from_records(rec).collect()] == [(1, 7, "X", 3)]


def test_corrupt_files_are_skipped(spark, tmp_path):
    from floodflow import schemas
    from floodflow.sources.files import read_parquet
    d = tmp_path / "e"
    spark.createDataFrame([(1.0, 2.0, 3)], "lat double, lon double, elevation int").write.parquet(str(d))
    (d / "part-99999-garbage.parquet").write_bytes(b"not a parquet file")
    assert read_parquet(spark, str(d), schemas.ELEVATION, ignore_corrupt=True).count() == 1
    with pytest.raises(Exception):
        read_parquet(spark, str(d), schemas.ELEVATION).count()


def test_kafka_job_is_gated(spark, tmp_path):
    import pytest
    if runner.kafka_available(spark):
        pytest.skip("connector present")
    with pytest.raises(RuntimeError, match="Kafka connector"):
        runner.start_kafka_job(spark, "localhost:9092", 10, str(tmp_path / "ck"))


def test_snapshot_stream_equals_batch_snapshot(spark, tmp_path):
    from floodflow.plans import snapshot
    from floodflow.streaming import snapshot_sink
    feat = "struct<type:string,properties:struct<geoname_id:string,name:string,population:long>,geometry:struct<type:string,coordinates:array<double>>>"
    schema = f"seq long, count long, change long, feature {feat}"

    def f(i, n):
        return ("Feature", (str(i), n, 500000), ("Point", [1.0, 2.0]))
    batches = [[(1, 10, 10, f(1, "A")), (1, 5, 5, f(2, "B"))],
               [(2, 30, None, f(1, "A")), (2, 0, 0, f(2, "B")), (2, 7, 7, None)],
               [(3, 40, 10, f(1, "A")), (3, 8, None, f(3, "C"))]]
    src = tmp_path / "src"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(src / f"b{i}"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(str(src))
    q = snapshot_sink.start(stream, str(tmp_path / "state"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = sorted(tuple(r) for r in snapshot_sink.snapshot_view(spark, str(tmp_path / "state")).collect())
    allrows = spark.createDataFrame([r for b in batches for r in b], schema)
    want = sorted(tuple(r) for r in snapshot.map_snapshot(allrows, ["seq"]).collect())
    assert got == want and len(got) == 2


def test_watermark_delay_accepts_earlier_events(spark, tmp_path):
    # The second file brings earlier events that are still within the delay:
    # city 3's first window moves earlier (before it reported anything) and
    # its first name changes; all totals equal the batch plan.
    import datetime as dt
    EV = "ts timestamp_ntz, event_id long, city_id long, city_name string, refugees long"

    def t(h, m=0):
        return dt.datetime(2024, 1, 1, h, m)
    first = [(t(5, 10), 1, 1, "A", 4), (t(6, 0), 2, 2, "B", 1), (t(9, 0), 3, 3, "C", 2),
             (t(9, 30), 6, 1, "A", 2)]
    second = [(t(7, 45), 4, 3, "C0", 3), (t(8, 0), 5, 2, "B", 5), (t(12, 0), 7, 2, "B", 1)]
    src = str(tmp_path / "src")
    runner.write_event_files(spark.createDataFrame(first, EV).coalesce(1), src + "/a", slices=1)
    time.sleep(1.1)
    runner.write_event_files(spark.createDataFrame(second, EV).coalesce(1), src + "/b", slices=1)
    got = sorted(tuple(r) for r in runner.run_files(spark, src, 3600, delay="2 hours").collect())
    # final watermark 12:00 - 2h = 10:00: windows up to 09:00-10:00 are reported
    ev = spark.createDataFrame(first + second, EV)
    until = F.lit(int(dt.datetime(2024, 1, 1, 9, 0, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000)
    want = sorted(tuple(r) for r in totals.dense_window_totals(ev, "1 hour", until_us=until).collect())
    assert got == want
    assert {r[1] for r in got if r[0] == 3} == {"C0"}


def test_events_table_as_a_folder_of_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    one = runner.run_table(spark, "/root/testdata/sf0.001", "events.parquet", 3600)
    many = runner.run_table(spark, str(tmp_path), "events.parquet", 3600)
    assert one.count() == many.count() > 0
    assert one.exceptAll(many).isEmpty()
