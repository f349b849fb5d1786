"""Streaming per-city windowed totals with keyed state.

Input: events (timestamp ms, city_id, city_name, refugees[, event_id]).
Output: one update per city and closed window (city_id, city_name,
window_start, refugees = running total, change), zeros included, for every
city seen so far — the stream form of ``plans.totals.dense_window_totals``.

Two time modes:
  * ``EventTime`` (deterministic): windows are aligned to the epoch; a
    window is emitted once the watermark passes its end. Equal to the batch
    plan with ``closed_only=True`` when the watermark delay is 0.
  * ``ProcessingTime`` (the reference's wall-clock ticks): every ``W``
    seconds each known city reports its total and the change since the
    previous tick; missed ticks are skipped, not replayed.

State lives in the RocksDB state store and is checkpointed, so totals
survive restarts (the reference kept them in memory only).

In event time the counting is Spark's own: a windowed aggregation under the watermark,
in append mode, gives one row per city and closed window (partial sums before the
shuffle, open windows in its state). Only those rows reach the Python processor, whose
part is what an aggregation cannot do: remember every city and report its quiet
windows. By the wall clock nothing closes, so there a stateless ``mapInPandas`` step
folds the events of each input partition to one row per city first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)

OUTPUT = T.StructType([
    T.StructField("city_id", T.LongType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("window_start", T.TimestampNTZType()),
    T.StructField("refugees", T.LongType()),
    T.StructField("change", T.LongType()),
])

FOLDED = "city_id long, w long, change long, name string, name_ts long, name_eid long"

# The processor also runs in a driver-side Python worker that does not see
# --py-files, so this module travels by value inside the pickled function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# All state of a key in one value (one read and one write per call through
# the state server): first name and its order, running total, end of the
# next window to report, whether anything was reported, and the windows (start,
# change) that have data and are not reported yet. In event time these are the
# windows that closed in the batch at hand, so the arrays stay short.
_STATE = ("name string, name_ts long, name_eid long, total long, next_end long, "
          "emitted boolean, ws array<long>, chs array<long>")
_BIG = 2 ** 62


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per-partition pre-aggregation to one row per city."""
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf.sort_values(["timestamp", "event_id"], kind="stable")
        g = pdf.groupby("city_id", sort=False)
        first = g.head(1).set_index("city_id")
        out = g.agg(change=("refugees", "sum")).join(first[["city_name", "timestamp", "event_id"]]).reset_index()
        yield pd.DataFrame({
            "city_id": out["city_id"].astype("int64"), "w": 0, "change": out["change"].astype("int64"),
            "name": out["city_name"], "name_ts": out["timestamp"].astype("int64"),
            "name_eid": out["event_id"].astype("int64")})


def _closed_windows(events: DataFrame, window_seconds: int, delay: str) -> DataFrame:
    """One row per city and window that the watermark has passed."""
    order = F.struct("timestamp", "event_id")
    return (events.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", delay)
            .groupBy("city_id", F.window("event_time", f"{window_seconds} seconds").alias("window"))
            .agg(F.sum("refugees").alias("change"), F.min_by("city_name", order).alias("name"), F.min(order).alias("o"))
            .select("city_id", F.unix_millis("window.start").alias("w"), "change", "name",
                    F.col("o.timestamp").alias("name_ts"), F.col("o.event_id").alias("name_eid"),
                    F.window_time("window").alias("event_time")))


class WindowTotals(StatefulProcessor):
    """Keyed state for one city; see ``_STATE``."""

    def __init__(self, window_ms: int, event_time: bool = True):
        self.window_ms = window_ms
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("city", _STATE)

    def _next_tick(self, now_ms: int) -> int:
        return now_ms - now_ms % self.window_ms + self.window_ms

    def _load(self):
        st = self.state.get()
        if st is None:
            return None, None, None, 0, None, False, {}
        name, name_ts, name_eid, total, next_end, emitted, ws, chs = st
        return name, name_ts, name_eid, total, next_end, emitted, dict(zip(ws or [], chs or []))

    def _save(self, name, name_ts, name_eid, total, next_end, emitted, open_w) -> None:
        ws = sorted(open_w)
        self.state.update((name, name_ts, name_eid, total, next_end, emitted,
                           ws, [open_w[w] for w in ws]))

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        name, name_ts, name_eid, total, next_end, emitted, open_w = self._load()
        first_end, named = next_end, name_ts is not None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                w = int(r.w) if self.event_time else 0
                if self.event_time and emitted and w + self.window_ms < next_end:
                    continue  # late: its window was already reported
                # The first name stays: by event time, or by the wall clock the first to
                # arrive (of one batch the earliest).
                if name_ts is None or (not named and (r.name_ts, r.name_eid) < (name_ts, name_eid)):
                    name, name_ts, name_eid = r.name, int(r.name_ts), int(r.name_eid)
                open_w[w] = open_w.get(w, 0) + int(r.change)
                if self.event_time and (next_end is None or w + self.window_ms < next_end):
                    # Before the first report the first window may still move
                    # earlier (rows within the watermark delay).
                    next_end = w + self.window_ms
        if not self.event_time and next_end is None:
            next_end = self._next_tick(timerValues.getCurrentProcessingTimeInMs())
        if next_end != first_end:
            if first_end is not None:
                self.handle.deleteTimer(first_end)
            self.handle.registerTimer(next_end)
        self._save(name, name_ts, name_eid, total, next_end, emitted, open_w)
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        name, name_ts, name_eid, total, next_end, emitted, open_w = self._load()
        out = []
        if self.event_time:
            wm = timerValues.getCurrentWatermarkInMs()
            end = next_end
            while end <= wm:
                w = end - self.window_ms
                ch = open_w.pop(w, 0)
                total += ch
                out.append((key[0], name, w, total, ch))
                end += self.window_ms
            next_end = end
        else:
            ch = open_w.pop(0, 0)
            total += ch
            out.append((key[0], name, expiredTimerInfo.getExpiryTimeInMs() - self.window_ms, total, ch))
            next_end = self._next_tick(max(timerValues.getCurrentProcessingTimeInMs(),
                                           expiredTimerInfo.getExpiryTimeInMs()))
        self.handle.registerTimer(next_end)
        self._save(name, name_ts, name_eid, total, next_end, emitted or bool(out), open_w)
        if out:
            pdf = pd.DataFrame(out, columns=["city_id", "city_name", "w", "refugees", "change"])
            yield pd.DataFrame({
                "city_id": pdf["city_id"].astype("int64"),
                "city_name": pdf["city_name"],
                "window_start": pd.to_datetime(pdf["w"], unit="ms"),
                "refugees": pdf["refugees"].astype("int64"),
                "change": pdf["change"].astype("int64"),
            })

    def close(self) -> None:
        pass


def windowed_updates(events: DataFrame, window_seconds: int, time_mode: str = "EventTime",
                     delay: str = "0 seconds") -> DataFrame:
    """Streaming (or batch) events -> updates; see the module docstring.

    ``events`` needs columns timestamp (epoch ms), city_id, city_name,
    refugees and optionally event_id (a tie-break for the first name)."""
    ev = events
    if "event_id" not in ev.columns:
        ev = ev.withColumn("event_id", F.lit(None).cast("long"))
    ev = (ev.select(F.col("timestamp").cast("long").alias("timestamp"), F.col("city_id").cast("long").alias("city_id"),
                    "city_name", F.coalesce(F.col("refugees").cast("long"), F.lit(0)).alias("refugees"),
                    F.coalesce(F.col("event_id").cast("long"), F.lit(_BIG)).alias("event_id"))
          .where(F.col("city_id").isNotNull() & F.col("timestamp").isNotNull()))
    event_time = time_mode == "EventTime"
    rows = _closed_windows(ev, window_seconds, delay) if event_time else ev.mapInPandas(_fold, FOLDED)
    return (rows.groupBy("city_id").transformWithStateInPandas(
        WindowTotals(window_seconds * 1000, event_time), OUTPUT, "Append", time_mode))


def encode_updates(updates: DataFrame) -> DataFrame:
    """(key, value) records for a message bus: key = city id as text."""
    return updates.select(
        F.col("city_id").cast("string").alias("key"),
        F.to_json(F.struct("city_id", "city_name", "refugees", "change"), {"ignoreNullFields": "false"}).alias("value"))
