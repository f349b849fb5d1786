"""Token-id shards with a minimal perfect hash index.

``write`` range-partitions documents by id, so every task holds one run of ids
in ascending order, and streams its ids as raw little-endian integers into one
``.ids`` file. Beside it goes an ``.mph`` file: a minimal perfect hash over the
shard's keys (levels of bit arrays; a key sits at the first level where no
other key shares its bit, its slot is the rank of that bit) and, by slot, a
fingerprint, the offset of the first record and the place of its record
lengths. ``lookup`` sends keys to their shards by the manifest's key ranges and
reads payloads by position: a constant number of probes per key, no search.

File names are unique to a task attempt; only attempts whose task succeeded get
into the manifest, so retries and lost executors leave the index right.

Files go through ``pyarrow.fs`` into the cluster's shared folder.

Defined cases: a null or empty text is the end id alone; a null doc_id has a key
of its own, before all others; rows that repeat a doc_id are separate records
under that key, in order of a hash of the text; keys that are not in the index
give no row; an empty table writes no shard. Extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodflow.llm.base import materialize, row_key, shared_dir
from floodflow.llm.blocks import mix
from floodflow.llm.tokens import Encoder, default_tokenizer
from floodflow.llm.words import blocks

END_ID = 2
_NO_ID = -(1 << 63)
_LOAD = 1.6  # bits per key of a level
_BLOCK = 512
_READ = 1 << 20  # ids read at once
_PRINT_SEED = np.uint64(0x2545F4914F6CDD1D)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, from arrays of bits."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        ones = np.unpackbits(bits, bitorder="little")
        self.ranks = np.concatenate(([0], np.cumsum(ones.reshape(-1, _BLOCK).sum(1, dtype=np.int64))))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = mix(np.array([level + 1], np.uint64))[0]
        return (mix(keys ^ seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys.astype(np.uint64)
        while len(left):
            size = -(-int(len(left) * _LOAD + 1) // _BLOCK) * _BLOCK
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            sizes.append(size)
            parts.append(np.packbits(bits, bitorder="little"))
            left = left[~alone]
        return cls(sizes, np.concatenate(parts) if parts else np.empty(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; keys not built in get any slot, or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._place(keys[todo], level, size)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[todo[hit]] = self._rank(at[hit])
            todo, base = todo[~hit], base + size
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        lanes = self.bits.reshape(-1, _BLOCK // 8)[at // _BLOCK]
        ones = np.unpackbits(lanes, axis=1, bitorder="little") if len(at) else np.empty((0, _BLOCK), np.uint8)
        before = np.arange(_BLOCK)[None, :] < (at % _BLOCK)[:, None]
        return self.ranks[at // _BLOCK] + (ones * before).sum(1)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ _PRINT_SEED) >> np.uint64(32)).astype("<u4")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).get_vocab_size()


_MANIFEST = ("task int, ids_file string, index_file string, low long, high long, n_docs long, n_ids long")


def write(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None,
          cut: str | None = "space_drop", end_id: int = END_ID) -> DataFrame:
    """Write shards and return the manifest, one row per shard."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-index")
    path = tokenizer or default_tokenizer("word_bpe_49k.json")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
                       row_key("doc_id", "text").alias("rk"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    width = 2 if _vocabulary(path) <= 1 << 16 and end_id < 1 << 16 else 4
    rows = rows.repartitionByRange(F.col("doc"), F.col("rk")).sortWithinPartitions("doc", "rk")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, out, fs, name = None, None, None, ""
        docs_, sizes = [], []
        for batch in it:
            if not batch.num_rows:
                continue
            if out is None:
                enc = Encoder.shared(path, cut, f"<u{width}")
                fs, root = _open(folder)
                fs.create_dir(root, recursive=True)
                name = f"{root}/shard-{uuid.uuid4().hex}"
                out = fs.open_output_stream(name + ".ids")
                end = np.array([end_id], f"<u{width}").tobytes()
            docs_.append(batch.column("doc").to_numpy())
            texts = batch.column("text").to_pylist()
            for lo, hi in blocks(texts):
                if cut == "space_drop":
                    ids, many = enc.encode_words(texts[lo:hi], end_id)
                    out.write(ids)
                else:
                    parts = enc.encode([t.decode() for t in texts[lo:hi]])
                    many = np.array([len(x) // width + 1 for x in parts], np.int64)
                    out.write(end.join([*parts, b""]))
                sizes.append(many)
        if out is None:
            return
        out.close()
        doc, size = np.concatenate(docs_), np.concatenate(sizes)
        keys, first = np.unique(doc, return_index=True)
        starts = np.concatenate(([0], np.cumsum(size)))
        hashed = mix(keys.view(np.uint64))
        mph = PerfectHash.build(hashed)
        slot = mph.slots(hashed)
        order = np.empty(len(keys), np.int64)
        order[slot] = np.arange(len(keys))
        with fs.open_output_stream(name + ".mph") as f:
            parts = [mph.bits, fingerprint(hashed)[order], starts[first][order].astype("<u8"),
                     first[order].astype("<u8"), np.diff(np.r_[first, len(doc)])[order].astype("<u4"),
                     size.astype("<u8")]
            head = json.dumps({"width": width, "sizes": mph.sizes, "keys": len(keys), "docs": len(doc),
                               "bytes": [p.nbytes for p in parts]}).encode()
            f.write(len(head).to_bytes(8, "little") + head)
            for p in parts:
                f.write(p.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in (
                (TaskContext.get().partitionId(), pa.int32()), (name.rsplit("/", 1)[1] + ".ids", pa.string()),
                (name.rsplit("/", 1)[1] + ".mph", pa.string()), (int(keys[0]), pa.int64()),
                (int(keys[-1]), pa.int64()), (len(doc), pa.int64()), (int(starts[-1]), pa.int64()))],
            names=["task", "ids_file", "index_file", "low", "high", "n_docs", "n_ids"])

    return materialize(rows.mapInArrow(run, _MANIFEST), "token-manifest").withColumn("folder", F.lit(folder))


class Shard:
    """One shard opened for keyed reads."""

    def __init__(self, folder: str, ids_file: str, index_file: str):
        fs, root = _open(folder)
        self.ids = fs.open_input_file(f"{root}/{ids_file}")
        with fs.open_input_stream(f"{root}/{index_file}") as f:
            raw = f.read()
        n = int.from_bytes(raw[:8], "little")
        head = json.loads(raw[8:8 + n])
        at, parts = 8 + n, []
        for size, kind in zip(head["bytes"], ("u1", "<u4", "<u8", "<u8", "<u4", "<u8"), strict=True):
            parts.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
            at += size
        bits, self.prints, self.offsets, self.firsts, self.counts, self.lengths = parts
        self.width = head["width"]
        self.mph = PerfectHash(head["sizes"], bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the fingerprint says it is absent."""
        hashed = mix(keys.view(np.uint64))
        slot = self.mph.slots(hashed)
        slot[(slot >= 0) & (self.prints[slot] != fingerprint(hashed))] = -1
        return slot

    def records(self, slots: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(index in ``slots``, offset in ids, ids as little-endian uint32) of all records
        of the slots. Records that follow each other in the file are read at once, up
        to ``_READ`` ids or one longer record."""
        run: list[tuple[int, int, int]] = []

        def read() -> Iterator[tuple[int, int, bytes]]:
            start, size = run[0][1], sum(n for _, _, n in run)
            raw = np.frombuffer(self.ids.read_at(size * self.width, start * self.width), f"<u{self.width}").astype("<u4")
            for i, at, n in run:
                yield i, at, raw[at - start:at - start + n].tobytes()

        for i, slot in enumerate(slots.tolist()):
            if slot < 0:
                continue
            at, first = int(self.offsets[slot]), int(self.firsts[slot])
            for n in self.lengths[first:first + int(self.counts[slot])].tolist():
                if run and (run[-1][1] + run[-1][2] != at or at + n - run[0][1] > _READ):
                    yield from read()
                    run = []
                run.append((i, at, n))
                at += n
        if run:
            yield from read()


def lookup(spark: SparkSession, manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Records of the ``doc_id`` keys: doc_id, start (ids of all documents before),
    n_tokens, ids. The manifest has one row per shard, as many as tasks wrote it."""
    shards = sorted(manifest.collect(), key=lambda r: r["task"])
    lows, highs = (np.array([r[c] for r in shards], np.int64) for c in ("low", "high"))
    starts = np.concatenate(([0], np.cumsum([r["n_ids"] for r in shards]))).astype(np.int64)
    files = [(r["folder"], r["ids_file"], r["index_file"]) for r in shards]
    shared = spark.sparkContext.broadcast((lows, highs, starts, files))

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, _, _ = shared.value
        for batch in it:
            key = batch.column("doc").to_numpy()
            a, b = np.searchsorted(high, key, "left"), np.searchsorted(low, key, "right")
            many = np.maximum(b - a, 0)  # a repeated id can cross shards
            shard = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.repeat(key, many))],
                                             names=["shard", "doc"])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, start, files = shared.value
        now, shard = -1, None
        for batch in it:
            where, key = batch.column("shard").to_numpy(), batch.column("doc").to_numpy()
            rows: list[tuple] = []
            cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(where)], strict=True):
                if where[lo] != now:
                    now, shard = int(where[lo]), Shard(*files[where[lo]])
                for i, at, ids in shard.records(shard.find(key[lo:hi])):
                    k = int(key[lo + i])
                    rows.append((None if k == _NO_ID else k, int(start[now]) + at, len(ids) // 4, ids))
                    if len(rows) >= 1000:
                        yield _records(rows)
                        rows = []
            if rows:
                yield _records(rows)

    asked = keys.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc")).distinct()
    # As many tasks as shards: a payload is some hundred times its key, so the size of the
    # keys says nothing about the work.
    return (asked.mapInArrow(route, "shard long, doc long").repartition(max(len(files), 1), F.col("shard"))
            .sortWithinPartitions("shard", "doc")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary"))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["doc_id", "start", "n_tokens", "ids"])
