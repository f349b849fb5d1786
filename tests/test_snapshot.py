"""Map snapshot: latest values, ratio guards, sampling."""

from pyspark.sql import functions as F

from floodflow.operators.sample import weighted_sample
from floodflow.plans import snapshot

ENR = "seq long, count long, change long, feature struct<type:string,properties:struct<geoname_id:string,name:string,population:long>,geometry:struct<type:string,coordinates:array<double>>>"


def feat(i, name):
    return ("Feature", (str(i), name, 500000), ("Point", [1.0, 2.0]))


def test_latest_state_and_guards(spark):
    rows = [(1, 10, 10, feat(1, "A")), (2, 30, None, feat(1, "A")),   # latest change null -> keep 10
            (1, 0, 0, feat(2, "B")),                                     # count 0: hidden
            (1, 40, 0, feat(3, "C")),                                    # change 0 -> ratio 0
            (3, 99, 5, None)]                                            # no feature: ignored
    df = spark.createDataFrame(rows, ENR)
    snap = {r.city_id: r for r in snapshot.map_snapshot(df, ["seq"]).collect()}
    assert set(snap) == {1, 3}
    a, c = snap[1], snap[3]
    assert (a["count"], a.change, a.share, a.ratio) == (30, 10, 30 / 40, 10 / 30)
    assert (c.ratio, c.fill_opacity, c.radius) == (0.0, 0.0, 14.0)
    assert a.fill_opacity == 0.5


def test_weighted_sample_is_deterministic_and_skips_zero_weights(spark):
    df = spark.range(1, 500).select(F.col("id"), F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("id")).alias("w"))
    a = [r.id for r in weighted_sample(df, "id", "w", k=20, seed=3).collect()]
    b = [r.id for r in weighted_sample(df, "id", "w", k=20, seed=3).collect()]
    assert a == b and len(set(a)) == 20 and all(i % 5 for i in a)


def test_weighted_sample_follows_seed_and_weights(spark):
    rows = [(10_000_000_000 + i, 9.0 if i % 2 else 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, w double")
    draws = [frozenset(r.id for r in weighted_sample(df, "id", "w", k=20, seed=s).collect()) for s in range(12)]
    assert len(set(draws)) == len(draws)
    heavy = sum(i % 2 for d in draws for i in d) / (20 * len(draws))
    assert 0.8 < heavy < 0.97  # nine to one by weight


def test_state_log_grows_with_changes_and_drops_old_files(spark, tmp_path):
    import os
    import random

    from floodflow.streaming import snapshot_sink
    table, rnd, rows = str(tmp_path / "state"), random.Random(1), []

    def size(part):
        return spark.read.parquet(f"{table}/{part}").count()

    for b in range(12):
        new = [(100 * b + i, rnd.randrange(50), rnd.choice([None, 3]), feat(rnd.randrange(1, 40), "N")) for i in range(5)]
        if b == 0:
            new = [(i, i, None, feat(i, "N")) for i in range(1, 40)]
        rows += new
        df = spark.createDataFrame(new, ENR).coalesce(1)
        snapshot_sink.fold_batch(spark, df, table, b, "seq", compact_after=3)
        before = sorted(os.listdir(table))
        snapshot_sink.fold_batch(spark, df, table, b, "seq", compact_after=3)  # replay
        assert sorted(os.listdir(table)) == before
        parts = [p for p in before if p != "pointers"]
        assert len(parts) <= 2 + 2 * 4 and len([p for p in os.listdir(f"{table}/pointers") if p.endswith(".json")]) <= 2
        if f"delta-{b:020d}" in parts:
            assert size(f"delta-{b:020d}") <= (39 if b == 0 else 5)  # only what changed
    got = sorted(map(tuple, snapshot_sink.snapshot_view(spark, table).collect()))
    want = sorted(map(tuple, snapshot.map_snapshot(spark.createDataFrame(rows, ENR), ["seq"]).collect()))
    assert got == want and len(got) > 20
    assert snapshot_sink.read_state(spark, str(tmp_path / "none")) is None


def test_state_log_survives_a_batch_that_died(spark, tmp_path):
    from floodflow.streaming import snapshot_sink
    table = str(tmp_path / "state")
    first = spark.createDataFrame([(1, 5, 5, feat(1, "A"))], ENR)
    second = spark.createDataFrame([(2, 9, None, feat(1, "A")), (2, 1, 1, feat(2, "B"))], ENR)
    snapshot_sink.fold_batch(spark, first, table, 0, "seq")
    # Dead after its delta and a torn pointer: the state is still the first batch's.
    snapshot_sink._changed(second, "seq").write.parquet(f"{table}/delta-{1:020d}")
    (tmp_path / "state" / "pointers" / f"{1:020d}.json.part").write_text("{")
    assert [tuple(r)[:3] for r in snapshot_sink.read_state(spark, table).collect()] == [(1, "A", 5)]
    snapshot_sink.fold_batch(spark, second, table, 1, "seq")
    assert sorted(tuple(r)[:4] for r in snapshot_sink.read_state(spark, table).collect()) == [(1, "A", 9, 5), (2, "B", 1, 1)]


def test_latest_state_is_hashed_and_follows_renames(spark):
    rows = [(1, 10, 10, feat(1, "Old")), (2, 30, None, feat(1, "New")), (3, 20, 4, feat(1, "Old")),
            (4, 7, None, feat(1, "New")), (None, 99, 99, feat(1, "Undated")), (None, 5, 6, feat(2, "B"))]
    st = snapshot.latest_state(spark.createDataFrame(rows, ENR), ["seq"])
    assert sorted(map(tuple, st.collect())) == [(1, "New", 7, 4), (2, "B", 5, 6)]
    two = snapshot.latest_state(spark.createDataFrame(rows[:4], ENR).withColumn("id", F.lit(1)), ["seq", "id"])
    assert list(map(tuple, two.collect())) == [(1, "New", 7, 4)]
    plan = st._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate(keys=[_k" in plan.replace("ObjectHashAggregate", "")


def test_updates_beyond_the_broadcast_bound_are_not_sorted(spark):
    cities = spark.createDataFrame([(1, feat(1, "A"))], "city_id long, " + ENR[ENR.index("feature"):])
    updates = spark.createDataFrame([(1, 5, 1), (2, 6, None), (None, 7, 0)], "city_id long, refugees long, change long")
    far = snapshot.enrich_updates(updates, cities, broadcast_bytes=0)
    near = snapshot.enrich_updates(updates, cities)
    assert sorted(map(str, far.collect())) == sorted(map(str, near.collect()))
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_dense_windows_are_dealt_by_their_number(spark, monkeypatch):
    from floodflow.plans import totals
    events = spark.range(80).selectExpr("id", "timestamp_ntz'2024-01-01' AS ts", "id AS event_id", "id AS city_id",
                                        "'x' AS city_name", "id AS refugees")
    want = sorted(map(tuple, totals.dense_window_totals(events).collect()))
    monkeypatch.setattr(totals, "WINDOWS_PER_TASK", 1)
    dense = totals.dense_window_totals(events)
    assert sorted(map(tuple, dense.collect())) == want and len(want) == 80
    assert dense.select(F.spark_partition_id().alias("p")).distinct().count() > 8
