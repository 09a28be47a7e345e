"""Token ids in raw shards with a keyed index (operator 6).

A shard is two files: `.ids`, the ids of its documents one after another as
little-endian unsigned integers (of 16 bits where the vocabulary allows it, else of
32), and `.idx`, which leads from a document key
to its place. The index is a minimal perfect hash: a chain of bit levels in which
every key owns one set bit, whose number among all set bits is the key's slot. The
slot holds a fingerprint, by which foreign keys are turned away, and the rows of
the key. A lookup reads one or two bits, one fingerprint and one offset, whatever
the size of the shard.

Shards are bounded in documents and bytes. A task writes under names of its own
attempt, and only shards that its returned rows name belong to the output, so a task
that is lost and run again leaves nothing wrong behind.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.llm.encoding import encoder, runs_of
from threadlens.storage import new_folder

# A shard ends at so many documents or so many ids, whatever comes first.
SHARD_DOCS = 1 << 16
SHARD_IDS = 1 << 24
MAGIC = b"TLIX0001"
# Bits per key in a level of the hash, and levels before the build gives up.
SPREAD = 2
LEVELS = 64

MANIFEST = "part int, seq int, first_key long, n_docs long, n_ids long, path string"
RECORD = "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key (the finaliser of splitmix64)."""
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, LEVELS + 1) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Different 64-bit keys to the numbers 0..n-1, one each."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(level, dtype=np.int64) for level in levels]
        sizes = [int(r[-1]) if len(r) else 0 for r in self.ranks]
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            if len(levels) == LEVELS:
                raise ValueError("keys are not different")
            size = max(64, SPREAD * len(rest))
            at = (_mixed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has a bit for it."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for number, level in enumerate(self.levels):
            at = (_mixed(keys[open_], number) % np.uint64(len(level))).astype(np.int64)
            hit = level[at]
            out[open_[hit]] = self.bases[number] + self.ranks[number][at[hit]] - 1
            open_ = open_[~hit]
        return out


def index_bytes(keys: np.ndarray, has_key: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    """The `.idx` file of a shard.

    `keys` ascend, equal ones adjacent; rows without a key come first and are found
    by row number only. `ends`: where each row's ids end in the payload, whose ids
    take `width` bytes each.
    """
    known = keys[has_key].view(np.uint64)
    first = int((~has_key).sum())
    different, rows, counts = np.unique(known, return_index=True, return_counts=True)
    table = PerfectHash.build(different)
    slots = table.slots(different)
    order = np.empty(len(slots), np.int64)
    order[slots] = np.arange(len(slots))
    head = {"width": width, "keys": len(different), "rows": len(keys), "no_key": first, "levels": [len(x) for x in table.levels]}
    text = json.dumps(head).encode()
    return b"".join(
        [
            MAGIC,
            len(text).to_bytes(4, "little"),
            text,
            *(np.packbits(x, bitorder="little").tobytes() for x in table.levels),
            fingerprints(different)[order].tobytes(),
            (rows[order] + first).astype("<u4").tobytes(),
            counts[order].astype("<u4").tobytes(),
            np.concatenate([[0], ends]).astype("<u8").tobytes(),
            keys.astype("<i8").tobytes(),
        ]
    )


class ShardIndex:
    """An `.idx` file in memory."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index file")
        size = int.from_bytes(data[8:12], "little")
        head, at = json.loads(data[12 : 12 + size]), 12 + size
        self.rows, self.no_key, self.kind = head["rows"], head["no_key"], f"<u{head['width']}"
        levels = []
        for bits in head["levels"]:
            packed = np.frombuffer(data, np.uint8, (bits + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=bits, bitorder="little").astype(bool))
            at += len(packed)
        self.hash = PerfectHash(levels)

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        n = head["keys"]
        self.prints, self.first, self.count = part("<u4", n), part("<u4", n), part("<u4", n)
        self.offsets, self.keys = part("<u8", self.rows + 1), part("<i8", self.rows)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its first row and number of rows; 0 rows for a foreign key."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        slots = self.hash.slots(keys)
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        right = (slots >= 0) & (self.prints[slots] == fingerprints(keys))
        return np.where(right, self.first[slots], 0).astype(np.int64), np.where(right, self.count[slots], 0).astype(np.int64)


def _writer(folder: str, file: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part, seq = TaskContext.get().partitionId(), 0
        top = max(encoder(file).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
        kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        keys, has, lengths, out, path = [], [], [], None, ""

        def close() -> pa.RecordBatch:
            nonlocal keys, has, lengths, out, seq
            out.close()
            ends = np.cumsum(np.concatenate(lengths))
            key = np.concatenate(keys)
            with store.open_output_stream(f"{path}.idx") as index:
                index.write(index_bytes(key, np.concatenate(has), ends, kind.itemsize))
            row = {"part": part, "seq": seq, "first_key": int(key[0]), "n_docs": len(key), "n_ids": int(ends[-1]), "path": path}
            keys, has, lengths, out, seq = [], [], [], None, seq + 1
            return pa.RecordBatch.from_pylist([row], _arrow(MANIFEST))

        for batch in batches:
            done = 0
            for run in runs_of(batch["text"]):
                ids, ends = encoder(file).encode(run)
                ids, ends = _with_end(ids, ends, end_id)
                key = batch["doc_id"].slice(done, len(run))
                done += len(run)
                at = 0
                while at < len(run):
                    if out is None:
                        path = f"{root}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}"
                        out = store.open_output_stream(f"{path}.ids")
                        docs = size = 0
                    before = ends[at - 1] if at else 0
                    stop = int(np.searchsorted(ends, before + SHARD_IDS - size, "right"))
                    stop = max(at + (docs == 0), min(stop, at + SHARD_DOCS - docs))
                    if stop > at:
                        out.write(ids[before : ends[stop - 1]].astype(kind).tobytes())
                        piece = key.slice(at, stop - at)
                        keys.append(piece.fill_null(0).to_numpy(zero_copy_only=False))
                        has.append(piece.is_valid().to_numpy(zero_copy_only=False))
                        lengths.append(np.diff(ends[at:stop], prepend=before))
                        docs, size, at = docs + stop - at, size + ends[stop - 1] - before, stop
                    if at < len(run):
                        yield close()
        if out is not None:
            yield close()

    return write


def _with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with the end id after each document."""
    return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def write_token_shards(docs: DataFrame, file: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode every text and write shards in ascending `doc_id` order.

    Returns the manifest, one row per shard: `part` and `seq` (shards ascend by them),
    `first_key`, `n_docs`, `n_ids`, `path` (of the two files, without suffix) and
    `base` (ids in all shards before it). It is stored in `<folder>/manifest`.

    Null text counts as empty: its row holds the end id only. Rows without `doc_id`
    come first and are found by row, not by key. Rows that repeat a `doc_id` stay
    together, ordered by text, and a lookup returns all of them. An empty table gives
    an empty manifest. Other columns are ignored.

    `folder` (default: a new one below the shared folder) is a URI of a store that
    `pyarrow.fs` reaches from every executor.
    """
    spark = docs.sparkSession
    folder = (folder or new_folder(spark, "tokens")).rstrip("/")
    store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    store.create_dir(f"{root}/shards", recursive=True)
    shards = f"{folder}/shards" if "://" in folder else f"file://{folder}/shards"
    rows = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange("doc_id", F.hash("text"))
        .sortWithinPartitions("doc_id", "text")
    )
    rows.mapInArrow(_writer(shards, file, end_id), MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of written shards with `base`."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard of up to 65,536 documents: a small table even for huge inputs.
    return (
        spark.read.schema(MANIFEST)
        .parquet(f"{folder}/manifest")
        .withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    )


def lookup(store: fs.FileSystem, path: str, keys: np.ndarray) -> list[list[np.ndarray]]:
    """For each key the ids of its rows in one shard, by the index alone."""
    with store.open_input_stream(f"{path}.idx") as f:
        index = ShardIndex(f.read())
    first, count = index.find(keys)
    with store.open_input_file(f"{path}.ids") as payload:
        out = []
        for a, n in zip(first, count):
            spans = [(int(index.offsets[r]), int(index.offsets[r + 1])) for r in range(a, a + n)]
            size = np.dtype(index.kind).itemsize
            out.append([np.frombuffer(payload.read_at((b - a) * size, a * size), index.kind) for a, b in spans])
        return out


def _reader(scheme: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(scheme)
        for shard in chain.from_iterable(b.to_pylist() for b in batches):
            with store.open_input_stream(f"{shard['path']}.idx") as f:
                index = ShardIndex(f.read())
            with store.open_input_stream(f"{shard['path']}.ids") as f:
                payload = np.frombuffer(f.read(), index.kind)
            # Every key is looked up by the hash; rows without one go by number.
            free = np.arange(index.no_key)
            first, count = index.find(np.unique(index.keys[index.no_key :]))
            rows = np.concatenate([free, np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())])
            if len(rows) != index.rows:
                raise ValueError(f"index of {shard['path']} does not lead to every row")
            a, b = index.offsets[rows].astype(np.int64), index.offsets[rows + 1].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(index.keys[rows], mask=rows < index.no_key),
                    pa.array(np.full(len(rows), shard["part"], np.int32)),
                    pa.array(np.full(len(rows), shard["seq"], np.int32)),
                    pa.array(a),
                    pa.array(b - a),
                    pa.array([zlib.crc32(payload[x:y].astype("<u4")) for x, y in zip(a, b)], pa.int64()),
                ],
                schema=_arrow(RECORD),
            )

    return read


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, read back from the shards: `doc_id`, `start` (ids of all documents
    before it), `n_tokens` (its ids with the end id) and `ids_crc32`."""
    shards = manifest.drop("base").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    rows = shards.mapInArrow(_reader(folder if "://" in folder else f"file://{folder}"), RECORD)
    return rows.join(F.broadcast(manifest.select("part", "seq", "base")), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
