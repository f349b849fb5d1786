"""Per-city windowed totals: the batch (event-time) form of the stream job.

For every city and every window from the city's first window on, the job
emits (city_id, city_name, refugees = running total, change = refugees that
arrived in the window); quiet windows report change 0. The name is the first
one seen for the city (ordered by event time, then event id).

Plan: events are first reduced to one row per (city, window) with partial
aggregation before the shuffle, so a city holding a third of all events costs
one row per window and map task. The dense form is a two-level prefix sum: the time
range is cut in blocks of ``BLOCK`` windows, block sums are added up per city (one row
per city and block), and inside a block the windows add up from its carry. No array,
group or window partition holds more than a block's windows, or a city's blocks, so
one city with a very long range is shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodflow.sources.files import materialize

US_PER_SECOND = 1_000_000
#: Windows that are added up together.
BLOCK = 512
#: Rows of the dense form that one task sorts.
WINDOWS_PER_TASK = 250_000


def window_us(length: str | int) -> int:
    """Window length in microseconds from seconds or an 'N unit' text."""
    if isinstance(length, int):
        return length * US_PER_SECOND
    n, unit = length.split()
    unit = unit.rstrip("s")
    scale = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
    return int(n) * scale * US_PER_SECOND


def event_micros(ts: str = "ts") -> Column:
    """Epoch microseconds of an event time (session time zone UTC)."""
    c = F.col(ts)
    return F.unix_micros(c.cast("timestamp"))


def window_start_us(us: Column, w_us: int) -> Column:
    """Start of the tumbling window holding ``us`` (epoch-aligned, exact
    integer arithmetic, also before 1970)."""
    return us - F.pmod(us, F.lit(w_us))


def per_window(events: DataFrame, w_us: int, key: str = "city_id", name: str = "city_name",
               value: str = "refugees", ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """(key, w, change, name_w, first_w, last_us): one row per key and
    non-empty window."""
    order = F.struct(F.col(ts), F.col(tiebreak))
    return (events
            .withColumn("w", window_start_us(event_micros(ts), w_us))
            .groupBy(key, "w")
            .agg(F.sum(value).alias("change"),
                 F.min_by(F.col(name), order).alias("name_w"),
                 F.min(order).alias("first_w"),
                 F.max(event_micros(ts)).alias("last_us")))


def first_name(events: DataFrame, key: str = "city_id", name: str = "city_name",
               ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """(key, name): the first name seen per key; later names are ignored."""
    return events.groupBy(key).agg(
        F.min_by(F.col(name), F.struct(F.col(ts), F.col(tiebreak))).alias(name))


def window_change(events: DataFrame, length="1 hour", key: str = "city_id",
                  value: str = "refugees", ts: str = "ts") -> DataFrame:
    """(key, window_start, change) for non-empty windows only."""
    w_us = window_us(length)
    return (events.withColumn("w", window_start_us(event_micros(ts), w_us))
            .groupBy(key, "w").agg(F.sum(value).alias("change"))
            .select(key, _ts_out("w").alias("window_start"), "change"))


def running_total(events: DataFrame, length="1 hour", key: str = "city_id",
                  value: str = "refugees", ts: str = "ts") -> DataFrame:
    """(key, window_start, refugees) over non-empty windows: the total after
    each window."""
    ch = window_change(events, length, key, value, ts)
    w = Window.partitionBy(key).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return ch.select(key, "window_start", F.sum("change").over(w).alias("refugees"))


def _ts_out(us_col: str) -> Column:
    return F.timestamp_micros(F.col(us_col)).cast("timestamp_ntz")


def dense_window_totals(events: DataFrame, length="1 hour", key: str = "city_id",
                        name: str = "city_name", value: str = "refugees", ts: str = "ts",
                        tiebreak: str = "event_id", until_us: Column | None = None,
                        closed_only: bool = False) -> DataFrame:
    """(key, name, window_start, refugees, change), dense from each key's first
    window up to the last window of the data (or the window starting at
    ``until_us``). With ``closed_only`` the last window ends at or before the
    latest event time, as a stream with a zero-delay watermark emits it."""
    w_us = window_us(length)
    # One row per (key, window): far smaller than the events. Written once so
    # the events are scanned once; both bounds below read this table.
    pw = materialize(per_window(events, w_us, key, name, value, ts, tiebreak), "windows")
    keys = pw.groupBy(key).agg(F.min("w").alias("w0"),
                               F.min_by("name_w", "first_w").alias(name))
    if until_us is None:
        last_w, latest = pw.agg(F.max("w"), F.max("last_us")).first()
        if latest is None:
            until = 0
        elif closed_only:
            # Windows whose end is <= the latest event time.
            until = latest - latest % w_us - w_us
        else:
            until = last_w
        until_us = F.lit(until)
    block_us = F.lit(w_us * BLOCK)
    block = F.col("w") - F.pmod("w", block_us)
    # What happened in each block, and the blocks of every key from its first window on.
    filled = pw.where(F.col("w") <= until_us).groupBy(key, block.alias("block")).agg(
        F.sum("change").alias("sum"), F.map_from_entries(F.collect_list(F.struct("w", "change"))).alias("changes"))
    spine = keys.where(F.col("w0") <= until_us).withColumn("until", until_us)
    spine = spine.select(key, name, "w0", "until", F.explode(F.sequence(
        F.col("w0") - F.pmod("w0", block_us), F.col("until") - F.pmod("until", block_us), block_us)).alias("block"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (spine.join(filled.select(key, "block", "sum"), [key, "block"], "left")
               .withColumn("carry", F.coalesce(F.sum("sum").over(before), F.lit(0).cast("long"))).drop("sum"))
    # The changes join the blocks, not the windows: dealt out by (key, block), which the
    # sums below keep. The number follows the windows, as a block is 512 times its row; a
    # number equal to the join's own would be taken for the same and be coalesced by bytes.
    windows = keys.where(F.col("w0") <= until_us).agg(
        F.sum(F.lit(1) + F.floor((until_us - F.col("w0")) / F.lit(w_us)))).first()[0] or 0
    spark = events.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, windows // WINDOWS_PER_TASK + 1)
    tasks += tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (carried.join(filled.select(key, "block", "changes"), [key, "block"], "left")
            .repartition(tasks, key, "block")
            .select(key, name, "block", "carry", "changes", F.explode(F.sequence(
                F.greatest("w0", "block"), F.least("until", F.col("block") + block_us - w_us), F.lit(w_us))).alias("w"))
            .withColumn("change", F.coalesce(F.try_element_at("changes", F.col("w")), F.lit(0).cast("long"))))
    run = Window.partitionBy(key, "block").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, name, _ts_out("w").alias("window_start"),
                       (F.col("carry") + F.sum("change").over(run)).alias("refugees"), "change")
