"""Latest state per city kept up to date by a stream (the dashboard table).

The table is a small log: a ``base`` with one row per city, and a ``delta`` for each
micro-batch since, with a row for every city that the batch changed and no other. A
pointer file names the parts that make up the state; the newest pointer is the table.

A batch writes its delta, then a pointer, so its work grows with the cities it
changes. After ``COMPACT_AFTER`` deltas they are merged with the base into a new base.
Parts and pointers that neither the newest pointer nor the one before it names are
removed, so a reader that has just read a pointer still finds its files, and neither
listing nor disk grows with the age of the stream. A replayed batch finds its number in
the pointer and does nothing; one that failed before its pointer writes its part anew.
Updates never pass through the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodflow.plans.snapshot import map_snapshot

STATE_COLS = ["city_id", "name", "count", "change", "seq", "change_seq"]
#: Deltas that are merged into a new base.
COMPACT_AFTER = 8


class _Folder:
    """Hadoop file system access to the table's folder."""

    def __init__(self, spark: SparkSession, table: str):
        self.table, self.path = table, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(table).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str = "") -> list[str]:
        p = self.path(f"{self.table}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def pointers(self) -> list[dict]:
        """The newest pointers that are kept, newest first."""
        out = []
        for name in sorted((n for n in self.names("pointers") if n.endswith(".json")), reverse=True):
            stream = self.fs.open(self.path(f"{self.table}/pointers/{name}"))
            try:
                out.append(json.loads(bytes(stream.readAllBytes())) | {"file": name})
            finally:
                stream.close()
        return out

    def point(self, state: dict) -> None:
        """Write the pointer of a batch: a file appears whole, by a rename."""
        name = f"{self.table}/pointers/{state['batch']:020d}.json"
        part = self.path(name + ".part")
        stream = self.fs.create(part, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        self.fs.rename(part, self.path(name))

    def clean(self) -> None:
        """Remove what the two newest pointers do not need."""
        kept = self.pointers()
        for old in kept[2:]:
            self.fs.delete(self.path(f"{self.table}/pointers/{old['file']}"), False)
        needed = {p for state in kept[:2] for p in [state["base"], *state["deltas"]]}
        for name in self.names():
            if name.startswith(("base-", "delta-")) and name not in needed:
                self.fs.delete(self.path(f"{self.table}/{name}"), True)


def _merge(rows: DataFrame) -> DataFrame:
    """One row per city: the latest count and name, the latest known change."""
    return rows.groupBy("city_id").agg(
        F.max_by("name", "seq").alias("name"), F.max_by("count", "seq").alias("count"),
        F.max_by("change", "change_seq").alias("change"), F.max("seq").alias("seq"),
        F.max("change_seq").alias("change_seq")).select(*STATE_COLS)


def _changed(batch: DataFrame, order: str) -> DataFrame:
    """The state rows of one micro-batch alone."""
    o = F.col(order)
    f = batch.where(F.col("feature").isNotNull()).withColumn(
        "city_id", F.col("feature.properties.geoname_id").cast("long"))
    known = F.when(F.col("change").isNotNull(), o)
    return f.groupBy("city_id").agg(
        F.max_by(F.col("feature.properties.name"), o).alias("name"), F.max_by(F.col("count"), o).alias("count"),
        F.max_by(F.col("change"), known).alias("change"), F.max(o).alias("seq"), F.max(known).alias("change_seq")) \
        .select(*STATE_COLS)


def _parts(spark: SparkSession, table: str, state: dict) -> DataFrame | None:
    names = [p for p in [state["base"], *state["deltas"]] if p]
    return spark.read.parquet(*[f"{table}/{n}" for n in names]) if names else None


def read_state(spark: SparkSession, table: str) -> DataFrame | None:
    """The state as of the newest batch, None before the first."""
    pointers = _Folder(spark, table).pointers()
    rows = _parts(spark, table, pointers[0]) if pointers else None
    return None if rows is None else _merge(rows)


def fold_batch(spark: SparkSession, batch: DataFrame, table: str, batch_id: int, order: str,
               compact_after: int | None = None) -> None:
    """Add one micro-batch of enriched updates to the table."""
    folder = _Folder(spark, table)
    pointers = folder.pointers()
    state = pointers[0] if pointers else {"batch": -1, "base": None, "deltas": []}
    if batch_id <= state["batch"]:
        return  # this batch was already applied (replay after a failure)
    delta = f"delta-{batch_id:020d}"
    _changed(batch, order).write.mode("overwrite").parquet(f"{table}/{delta}")
    new = {"batch": batch_id, "base": state["base"], "deltas": [*state["deltas"], delta]}
    if len(new["deltas"]) > (COMPACT_AFTER if compact_after is None else compact_after):
        base = f"base-{batch_id:020d}"
        _merge(_parts(spark, table, new)).write.mode("overwrite").parquet(f"{table}/{base}")
        new |= {"base": base, "deltas": []}
    folder.point(new)
    folder.clean()


def start(enriched_stream: DataFrame, table: str, checkpoint: str, order: str = "seq", trigger=None):
    """Start the upsert stream; ``order`` is the column that orders updates."""
    spark = enriched_stream.sparkSession
    w = (enriched_stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: fold_batch(spark, df, table, bid, order)))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def snapshot_view(spark: SparkSession, table: str) -> DataFrame:
    """The map snapshot (share, ratio, style) from the newest state."""
    st = read_state(spark, table)
    feat = F.struct(F.struct(F.col("city_id").cast("string").alias("geoname_id"),
                             F.col("name").alias("name")).alias("properties"))
    rows = st.select(feat.alias("feature"), "count", "change", F.col("seq").alias("_o"))
    return map_snapshot(rows, ["_o"])
