"""The stream jobs, between any source and any sink.

A source is a streaming frame; a sink is a function from a frame to the stream writer
that stores it. Sources and sinks of records (``key``, ``value``) are the message log
(``sources/messages.py``) and, where the connector is installed, Kafka. Events also
come from files or from a table, and updates also go to Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from floodflow.session import DEFAULT_CONF
from floodflow.sources import messages
from floodflow.sources.codecs import encode_record, events_from_records
from floodflow.sources.files import shared_dir
from floodflow.streaming.enrich import enrich_stream
from floodflow.streaming.windowed import OUTPUT, encode_updates, windowed_updates

Sink = Callable[[DataFrame], DataStreamWriter]
POLL = {"processingTime": "0 seconds"}

STREAM_EVENT = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("city_id", T.LongType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("refugees", T.LongType()),
    T.StructField("event_id", T.LongType()),
])


# ------------------------------------------------------------------------- jobs

def _start(writer: DataStreamWriter, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_updates(events: DataFrame, sink: Sink, checkpoint: str, window_seconds: int,
                  time_mode: str = "EventTime", delay: str = "0 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Events -> one update per city and window, as columns."""
    # Keyed state with timers needs the RocksDB state store (read when a query starts).
    key = "spark.sql.streaming.stateStore.providerClass"
    events.sparkSession.conf.set(key, DEFAULT_CONF[key])
    return _start(sink(windowed_updates(events, window_seconds, time_mode, delay)), checkpoint, trigger)


def start_updates_job(records: DataFrame, sink: Sink, checkpoint: str, window_seconds: int, **kw) -> StreamingQuery:
    """Event records -> update records; the strict decoder fails on a bad event."""
    return start_updates(events_from_records(records, STREAM_EVENT, optional=("event_id",)),
                         lambda updates: sink(encode_updates(updates)), checkpoint, window_seconds, **kw)


def start_enrich_job(records: DataFrame, cities: DataFrame, sink: Sink, checkpoint: str,
                     cities_bytes: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Update records -> map event records; bad updates are dropped."""
    return _start(sink(enrich_stream(records, cities, cities_bytes)), checkpoint, trigger)


def finish(query: StreamingQuery) -> None:
    """Wait until a query has read all there is."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def drain(query: StreamingQuery) -> None:
    """Let a running query (``POLL``) work off all there is, closing windows included,
    and stop it. A topic is read this way: with ``availableNow`` a Python source ends
    after one batch, before the batch that closes windows."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def parquet_sink(path: str) -> Sink:
    return lambda stream: stream.writeStream.format("parquet").option("path", path).outputMode("append")


# ------------------------------------------------------------- files and tables

def write_event_files(events: DataFrame, path: str, slices: int = 4) -> None:
    """Write events as JSON files, one write per event-time slice (so file
    modification times follow event time)."""
    ev = events.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
                       "city_id", "city_name", "refugees", "event_id")
    for i, part in enumerate(_slices(ev, slices)):
        (part.sortWithinPartitions("timestamp", "event_id")
             .write.mode("errorifexists").json(f"{path}/slice={i:04d}"))


def _slices(events: DataFrame, slices: int) -> list[DataFrame]:
    """Events cut at equal steps of event time."""
    lo, hi = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    if lo is None:
        return []
    step = (hi - lo) // slices + 1
    cut = [lo + i * step for i in range(slices + 1)]
    return [events.where((F.col("timestamp") >= a) & (F.col("timestamp") < b)) for a, b in zip(cut, cut[1:], strict=False)]


def run_files(spark: SparkSession, events_dir: str, window_seconds: int,
              files_per_trigger: int = 1, delay: str = "0 seconds",
              out: str | None = None, ckpt: str | None = None) -> DataFrame:
    """Event-time run to completion (availableNow); returns the updates.
    Passing the same ``out``/``ckpt`` again resumes from the saved state."""
    out = out or shared_dir(spark, "updates")
    src = (spark.readStream.schema(STREAM_EVENT)
           .option("maxFilesPerTrigger", files_per_trigger)
           .option("recursiveFileLookup", "true")
           .json(events_dir))
    finish(start_updates(src, parquet_sink(out), ckpt or shared_dir(spark, "updates-ckpt"), window_seconds, delay=delay))
    return spark.read.parquet(out)


def table_events(table: DataFrame) -> DataFrame:
    """Stream events from rows of the driver's events table."""
    return table.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
                        F.col("user_id").alias("city_id"), F.col("event_type").alias("city_name"),
                        F.round(F.col("value") * F.lit(100.0)).cast("long").alias("refugees"), "event_id")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def run_table(spark: SparkSession, folder: str, name: str, window_seconds: int,
              out: str | None = None, ckpt: str | None = None) -> DataFrame:
    """Stream an events table (Parquet, a file or a folder) straight through the
    keyed-state job: no copy of the data. All files present at start form the
    first micro-batch (no rate limit), so no event can arrive behind the
    watermark; the closing batch reports every window that has ended."""
    out = out or shared_dir(spark, "updates")
    path = f"{folder.rstrip('/')}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders: a table that is one file is picked from its folder by name.
    src = (reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path))
    finish(start_updates(table_events(src), parquet_sink(out), ckpt or shared_dir(spark, "updates-ckpt"), window_seconds))
    return spark.read.parquet(out)


def event_records(events: DataFrame) -> DataFrame:
    """Records of stream events."""
    return encode_record(events, "city_id", list(STREAM_EVENT.names))


def run_topic(spark: SparkSession, events: DataFrame, window_seconds: int, slices: int = 2,
              topic: str | None = None, out: str | None = None, ckpt: str | None = None) -> DataFrame:
    """Play ``events`` (as ``STREAM_EVENT``) onto a topic in ``slices`` equal steps of
    event time while the keyed-state job reads it, a micro-batch or more per step;
    returns the updates. The same topic, ``out`` and ``ckpt`` resume."""
    topic, out = topic or shared_dir(spark, "events-topic"), out or shared_dir(spark, "updates")
    records = messages.stream_topic(spark, topic)
    query = start_updates(events_from_records(records, STREAM_EVENT, optional=("event_id", "city_name")),
                          parquet_sink(out), ckpt or shared_dir(spark, "updates-ckpt"), window_seconds,
                          trigger=POLL)
    try:
        for part in _slices(events, slices):
            messages.append(event_records(part), topic)
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(OUTPUT).parquet(out)


# ------------------------------------------------------------------------ Kafka

def kafka_available(spark: SparkSession) -> bool:
    """True when the Kafka source/sink connector is on the classpath."""
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:  # noqa: BLE001 - any failure means the class is absent
        return False


def kafka_source(spark: SparkSession, servers: str, topic: str, starting_offsets: str = "earliest") -> DataFrame:
    """A first start reads from ``starting_offsets``; later starts go on from the checkpoint."""
    if not kafka_available(spark):
        raise RuntimeError("the Kafka connector (spark-sql-kafka) is not on the classpath")
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", starting_offsets).load())


def kafka_sink(servers: str, topic: str) -> Sink:
    return lambda stream: (stream.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
                           .option("topic", topic).outputMode("append"))


def start_kafka_job(spark: SparkSession, servers: str, window_seconds: int, checkpoint: str,
                    events_topic: str = "events", updates_topic: str = "updates",
                    time_mode: str = "ProcessingTime", delay: str = "0 seconds",
                    starting_offsets: str = "earliest") -> StreamingQuery:
    """Events topic -> keyed-state updates -> updates topic (key = city id as text,
    value = JSON). Needs the Kafka connector on the classpath; raises a clear error
    otherwise."""
    records = kafka_source(spark, servers, events_topic, starting_offsets)
    return start_updates_job(records, kafka_sink(servers, updates_topic), checkpoint, window_seconds,
                             time_mode=time_mode, delay=delay, trigger=POLL)
