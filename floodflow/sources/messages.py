"""A replayable message log over files, as a Spark data source (``messagelog``).

A topic is a folder. Writers put records into files under ``data/``; a file counts
only once a commit under ``commits/`` names it. Commits are numbered, so a position in
the log is a number: the offset of a stream is the last commit it has read, and any
range of offsets can be read again with the same records in the same order.

A stream that writes to a topic names itself (option ``writer``). The commit of a
micro-batch carries that name and the batch number; a batch that is run again after a
failure finds its commit and adds nothing, which makes the chain source -> job ->
topic exactly-once. Files of failed attempts are never named by a commit.

Columns: ``key`` and ``value`` (text) as on a message bus, read with ``offset`` (the
commit), ``file`` and ``row`` (together a total order). Options: ``path``;
``startingOffsets`` (``earliest``, ``latest`` or a commit number already read);
``writer``. A micro-batch takes all commits since the one before. Paths are whatever ``pyarrow.fs`` opens and every
executor reaches. The commits of the range at hand reach the driver, records never do.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition,
    WriterCommitMessage,
)

FORMAT = "messagelog"
SCHEMA = "key string, value string, offset long, file int, row long"
FILE_ROWS = 100_000
_KEPT = pa.schema([("key", pa.string()), ("value", pa.string())])

# Data sources are planned in a driver-side Python worker that does not see
# --py-files, so this module travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Topic:
    """File access to one topic."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def commits(self) -> list[tuple[int, str, str]]:
        """(number, what was committed, path) in order."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        names = [i.base_name for i in found if i.base_name.endswith(".json")]
        return sorted((int(n[:20]), n[21:-5], f"{self.root}/commits/{n}") for n in names)

    def files(self, path: str) -> list[str]:
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def store(self, rows: Iterator) -> _Stored:
        """Write the records of one task, in files of at most ``FILE_ROWS`` rows."""
        files, kept = [], {"key": [], "value": []}
        self.fs.create_dir(f"{self.root}/data", recursive=True)

        def flush() -> None:
            if kept["value"]:
                files.append(f"data/{uuid.uuid4().hex}.parquet")
                pq.write_table(pa.table(kept, schema=_KEPT), f"{self.root}/{files[-1]}", filesystem=self.fs)
                kept["key"].clear()
                kept["value"].clear()

        for r in rows:
            kept["key"].append(r["key"])
            kept["value"].append(r["value"])
            if len(kept["value"]) >= FILE_ROWS:
                flush()
        flush()
        return _Stored(files)

    def commit(self, what: str, messages: list) -> None:
        """Name the files of one write; nothing happens if ``what`` is committed."""
        done = self.commits()
        if any(w == what for _, w, _ in done):
            return
        files = [f for m in messages if m is not None for f in m.files]
        number = done[-1][0] + 1 if done else 0
        self.fs.create_dir(f"{self.root}/commits", recursive=True)
        path = f"{self.root}/commits/{number:020d}-{what}.json"
        with self.fs.open_output_stream(path + ".part") as f:
            f.write(json.dumps(files).encode())
        self.fs.move(path + ".part", path)


@dataclass
class _Stored(WriterCommitMessage):
    files: list


@dataclass
class _File(InputPartition):
    path: str
    offset: int
    number: int


def _read(topic: _Topic, part: _File) -> Iterator[pa.RecordBatch]:
    row = 0
    with topic.fs.open_input_file(f"{topic.root}/{part.path}") as f:
        for b in pq.ParquetFile(f).iter_batches():
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("value"), pa.array([part.offset] * n, pa.int64()),
                 pa.array([part.number] * n, pa.int32()), pa.array(range(row, row + n), pa.int64())],
                names=["key", "value", "offset", "file", "row"])
            row += n


def _files(topic: _Topic, after: int, upto: int) -> list[_File]:
    return [_File(f, number, i) for number, _, path in topic.commits() if after < number <= upto
            for i, f in enumerate(topic.files(path))]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        return _files(_Topic(self.path), -1, sys.maxsize)

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _read(_Topic(self.path), partition) if isinstance(partition, _File) else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, start: str):
        self.path, self.start = path, start

    def latestOffset(self) -> dict:
        commits = _Topic(self.path).commits()
        return {"commit": commits[-1][0] if commits else -1}

    def initialOffset(self) -> dict:
        if self.start == "latest":
            return self.latestOffset()
        return {"commit": -1 if self.start == "earliest" else int(self.start)}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return _files(_Topic(self.path), start["commit"], end["commit"])

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _read(_Topic(self.path), partition)

    def commit(self, end: dict) -> None:
        """Nothing is dropped: a topic can always be read again."""


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.what = path, f"append-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Stored:
        return _Topic(self.path).store(iterator)

    def commit(self, messages: list) -> None:
        _Topic(self.path).commit(self.what, messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, path: str, writer: str):
        self.path, self.writer = path, writer

    def write(self, iterator: Iterator) -> _Stored:
        return _Topic(self.path).store(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        _Topic(self.path).commit(f"{self.writer}-{batchId}", messages)

    def abort(self, messages: list, batchId: int) -> None:
        """Files of a failed attempt stay unnamed."""


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"], str(self.options.get("startingOffsets", "earliest")))

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a topic is only appended to")
        return _Writer(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        if "writer" not in self.options:
            raise ValueError("a stream that writes to a topic needs a name: option 'writer'")
        return _StreamWriter(self.options["path"], self.options["writer"])


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """All records of a topic, as a batch."""
    spark.dataSource.register(MessageLog)
    return spark.read.format(FORMAT).option("path", path).load()


def stream_topic(spark: SparkSession, path: str, start: str | int = "earliest") -> DataFrame:
    """The records of a topic as a stream."""
    spark.dataSource.register(MessageLog)
    return (spark.readStream.format(FORMAT).option("path", path).option("startingOffsets", str(start)).load())


def append(records: DataFrame, path: str) -> None:
    """Add a batch of (key, value) records as one commit."""
    records.sparkSession.dataSource.register(MessageLog)
    records.select("key", "value").write.format(FORMAT).option("path", path).mode("append").save()


def topic_sink(path: str, writer: str):
    """A sink for the jobs: writes (key, value) records to a topic."""

    def sink(stream: DataFrame):
        stream.sparkSession.dataSource.register(MessageLog)
        return (stream.select("key", "value").writeStream.format(FORMAT).option("path", path)
                .option("writer", writer).outputMode("append"))

    return sink
