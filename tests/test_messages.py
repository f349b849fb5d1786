"""The message log and the two jobs on it: order, replay, restarts."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from floodflow.plans import snapshot, totals
from floodflow.sources import codecs, messages, tables
from floodflow.streaming import runner

SF = "/root/testdata/sf0.001"
FEATURE = ("city_id long, feature struct<type:string,properties:struct<geoname_id:string,name:string,"
           "population:long>,geometry:struct<type:string,coordinates:array<double>>>")


def records(spark, *values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "key string, value string")


def test_commits_keep_their_order_and_count_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    messages.append(records(spark, "a", "b").coalesce(1), path)
    messages.append(records(spark, "c", None).repartition(2), path)
    got = messages.read_topic(spark, path).orderBy("offset", "file", "row").collect()
    assert [r.value for r in got[:2]] == ["a", "b"] and {r.value for r in got[2:]} == {"c", None}
    assert [r.offset for r in got] == [0, 0, 1, 1]
    topic = messages._Topic(path)
    stored = topic.store(iter([{"key": "k", "value": "d"}]))
    topic.commit("job-7", [stored, None])
    topic.commit("job-7", [topic.store(iter([{"key": "k", "value": "again"}]))])  # a batch run twice
    assert [w for _, w, _ in topic.commits()][2:] == ["job-7"]
    assert messages.read_topic(spark, path).count() == 5
    monkeypatch.setattr(messages, "FILE_ROWS", 3)
    assert len(topic.store(iter([{"key": None, "value": str(i)} for i in range(7)])).files) == 3
    empty = messages.read_topic(spark, str(tmp_path / "none"))
    assert empty.count() == 0
    with pytest.raises(Exception):
        records(spark, "x").write.format(messages.FORMAT).option("path", path).mode("overwrite").save()


def test_a_stream_starts_where_it_is_told(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in ("a", "b", "c"):
        messages.append(records(spark, v), path)

    def values(start, name):
        q = (messages.stream_topic(spark, path, start).writeStream.format("memory").queryName(name)
             .trigger(availableNow=True).start())
        runner.finish(q)
        return sorted(r.value for r in spark.sql(f"select value from {name}").collect())

    assert values("earliest", "m0") == ["a", "b", "c"]
    assert values(0, "m1") == ["b", "c"]
    assert values("latest", "m2") == []


def test_two_jobs_survive_kills_without_loss_or_repeat(spark, tmp_path):
    """events topic -> updates topic -> map events topic. Both jobs are stopped between
    and within their work, and the last batch of each is run twice."""
    ev, up, out, ck1, ck2 = (str(tmp_path / n) for n in ("events", "updates", "out", "ck1", "ck2"))
    events = runner.table_events(tables.table(spark, SF, "events"))
    city = tables.city_events(spark, SF)
    cities = spark.createDataFrame([(i, ("Feature", (str(i), f"C{i}", 500000), ("Point", [1.0, 2.0])))
                                    for i in range(0, 200, 2)], FEATURE)

    def updates():
        q = runner.start_updates_job(messages.stream_topic(spark, ev), messages.topic_sink(up, "updates"), ck1, 3600,
                                     trigger=runner.POLL)
        runner.drain(q)

    def enrich():
        q = runner.start_enrich_job(messages.stream_topic(spark, up), cities, messages.topic_sink(out, "enriched"), ck2,
                                    trigger=runner.POLL)
        runner.drain(q)

    def forget_last_commit(ck):
        """As if the job died after its sink had committed, before the checkpoint had."""
        done = sorted((n for n in os.listdir(f"{ck}/commits") if n.isdigit()), key=int)
        os.remove(f"{ck}/commits/{done[-1]}")
        crc = f"{ck}/commits/.{done[-1]}.crc"
        if os.path.exists(crc):
            os.remove(crc)

    parts = runner._slices(events, 3)
    messages.append(runner.event_records(parts[0]), ev)
    updates()
    enrich()
    forget_last_commit(ck1)
    forget_last_commit(ck2)
    messages.append(runner.event_records(parts[1]), ev)
    # Killed while running: what it had committed stays, the rest comes at the restart.
    q = runner.start_updates_job(messages.stream_topic(spark, ev), messages.topic_sink(up, "updates"), ck1, 3600,
                                 trigger=runner.POLL)
    while not q.lastProgress:
        time.sleep(0.2)
    q.stop()
    messages.append(runner.event_records(parts[2]), ev)
    enrich()
    updates()
    enrich()

    want = totals.dense_window_totals(city, "1 hour", closed_only=True).select("city_id", "city_name", "refugees", "change")
    got = messages.read_topic(spark, up).select(F.from_json("value", want.schema).alias("u")).select("u.*")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    batch = snapshot.enrich_updates(codecs.decode_tolerant(codecs.encode_record(
        want, "city_id", want.columns).select("value"), "value"), cities).select(snapshot.encode_event().alias("value"))
    there = messages.read_topic(spark, out).select("value")
    assert there.count() == batch.count() and there.exceptAll(batch).isEmpty()


def test_topic_run_equals_batch_in_several_batches(spark, tmp_path):
    topic = str(tmp_path / "t")
    events = runner.table_events(tables.table(spark, SF, "events"))
    got = runner.run_topic(spark, events, 3600, slices=2, topic=topic)
    want = totals.dense_window_totals(tables.city_events(spark, SF), "1 hour", closed_only=True)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).isEmpty()
    assert len(messages._Topic(topic).commits()) == 2


def test_python_sees_closed_windows_only(spark):
    """The processor's input is the aggregation's output: a third of all events in one
    window of one city is one row."""
    from floodflow.streaming.windowed import _closed_windows
    rows = [(1000 + i, 1, "A", 1, i) for i in range(300)] + [(5_000_000, 2, "B", None, 1)]
    ev = spark.createDataFrame(rows, "timestamp long, city_id long, city_name string, refugees long, event_id long")
    got = sorted(tuple(r)[:4] for r in _closed_windows(ev, 3600, "0 seconds").collect())
    assert got == [(1, 0, 300, "A"), (2, 3_600_000, None, "B")]


def test_null_refugees_count_nothing(spark, tmp_path):
    rows = [(1000, 1, "A", None, 1), (2000, 1, "A", 4, 2), (9_000_000, 1, "A", 1, 3), (9_000_000, None, "?", 5, 4)]
    ev = spark.createDataFrame(rows, "timestamp long, city_id long, city_name string, refugees long, event_id long")
    ev.coalesce(1).write.json(str(tmp_path / "e"))
    got = runner.run_files(spark, str(tmp_path / "e"), 3600).orderBy("window_start").collect()
    assert [(r.refugees, r.change) for r in got] == [(4, 4), (4, 0)]


def test_strict_decoder_needs_one_whole_object(spark):
    good = '{"timestamp":1,"city_id":7,"city_name":"X","refugees":3}'

    def decode(text):
        return [tuple(r) for r in codecs.events_from_records(records(spark, text)).collect()]

    assert decode(good) == decode(f" {good}\n") == [(1, 7, "X", 3)]
    assert decode(good[:-1] + ',"more":{"a":[1]}}') == [(1, 7, "X", 3)]
    for bad in (good + " x", good + good, good + ',"end":1', good[:-1], good.replace('"X"', "null"), "[]", "",
                good.replace('"city_name":"X",', ""), good[:-1] + ',"refugees":4}', good + '],"e":[' + good):
        with pytest.raises(Exception):
            decode(bad)
    optional = codecs.events_from_records(records(spark, good.replace('"X"', "null")), optional=("city_name",))
    assert [tuple(r) for r in optional.collect()] == [(1, 7, None, 3)]


def test_wall_clock_name_is_the_first_to_arrive():
    import pandas as pd

    from floodflow.streaming.windowed import WindowTotals

    class Value:
        kept = None

        def get(self):
            return self.kept

        def update(self, v):
            self.kept = v

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, _):
            pass

        def deleteTimer(self, _):
            pass

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 5

    p = WindowTotals(1000, event_time=False)
    p.init(Handle())
    cols = ["w", "change", "name", "name_ts", "name_eid"]
    p.handleInputRows((1,), iter([pd.DataFrame([(0, 1, "late clock", 90, 1), (0, 1, "first", 80, 1)], columns=cols)]), Clock())
    p.handleInputRows((1,), iter([pd.DataFrame([(0, 1, "older stamp", 10, 1)], columns=cols)]), Clock())
    assert p.state.get()[0] == "first"


def test_commit_files_are_plain_lists(spark, tmp_path):
    path = str(tmp_path / "t")
    messages.append(records(spark, "a"), path)
    (_, _, commit), = messages._Topic(path).commits()
    with open(commit) as f:
        files = json.load(f)
    assert files and all(os.path.exists(f"{path}/{f}") for f in files)
