"""Token ids in binary shards with a minimal perfect hash index.

Texts are range-partitioned by id and encoded in that order; each partition writes one shard: a
header and the raw ids of its documents, one after another, with an end id after each. An entry
(document key, shard, position, number of ids) goes to the index: entries fall into buckets by a
hash of their key, and each bucket is a file with a minimal perfect hash of its keys. Level by
level, keys are hashed into a bit array of twice their number; a key that is alone in its place
is settled, the others go on. A key's slot is the number of bits set before its own; the slot
holds a fingerprint of the key and the document's place, in an entry of fixed width. A lookup
probes a few bits and reads one entry by its position, whatever the size of the store. Keys whose
64-bit hashes agree cannot be parted by bits; they are listed with a second hash.

Files go to a folder all executors share, under a name of the partition alone; they are written
beside it and renamed, so a task that runs twice leaves the same file. Tasks hold one batch of
texts, and a bucket has about BUCKET keys.

Defined results: a null text is an empty one, which is a single end id. Repeated ids are keys
with a running number. A null id is a key like others, before all. Empty tables write no
entries, and lookups in them find nothing. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odflux.llm.common import materialize, partitions, scratch_path, table
from odflux.llm.registry import query
from odflux.llm.tokens import TOKENIZER, crc32, encoder

MAGIC = b"IDSHARD1"
HEADER = 16
BUCKET = 1 << 15
INDEX_MAGIC = b"IDINDEX2"
INDEX = struct.Struct("<8sIIQQ")  # levels, clashes, slots before the clashes, slots
ENTRY = np.dtype([("print", "<u4"), ("n_tokens", "<u4"), ("shard", "<u8"), ("position", "<u8")])
FEW = 64  # entries that are read one by one
U = np.uint64


# --- Files in the shared folder ----------------------------------------------------------------

def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


class _Writer:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str):
        self.system, self.root = open_folder(folder)
        self.system.create_dir(self.root, recursive=True)
        self.target, self.draft = f"{self.root}/{name}", f"{self.root}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.draft)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def finish(self) -> None:
        self.stream.close()
        self.system.move(self.draft, self.target)


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.ids"


# --- Minimal perfect hashing ----------------------------------------------------------------------

def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class PerfectHash:
    """Slots 0 to n-1 for n different pairs of 64-bit hashes.

    Bit arrays settle the keys whose first hash no other key has. Keys that share it, which no
    number of levels would part, get the last slots from an exact list of both hashes.
    """

    def __init__(self, hashes: np.ndarray, seconds: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # places, bits, bits set before each word
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        shared = np.zeros(len(hashes), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        left, settled, level = hashes[~shared], 0, 0
        while len(left):
            places = max(64, 2 * len(left))
            at = (_mix(left, level) % U(places)).astype(np.int64)
            alone = np.bincount(at, minlength=places) == 1
            words = np.packbits(np.pad(alone, (0, -places % 64)), bitorder="little").view(U)
            before = settled + np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
            self.levels.append((places, words, before[:-1]))
            settled = int(before[-1])
            left = left[~alone[at]]
            level += 1
        self.settled = settled
        clashes = np.flatnonzero(shared)
        clashes = clashes[np.lexsort((seconds[clashes], hashes[clashes]))]
        self.clashes = np.stack((hashes[clashes], seconds[clashes]), axis=1)
        if (self.clashes[1:] == self.clashes[:-1]).all(axis=1).any():
            raise ValueError("two keys agree in all 128 bits of their hashes")

    def slots(self, hashes: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 if it certainly has none."""
        out = np.full(len(hashes), -1, np.int64)
        first = np.searchsorted(self.clashes[:, 0], hashes)
        listed = np.searchsorted(self.clashes[:, 0], hashes, "right") > first
        for k in np.flatnonzero(listed).tolist():
            at = int(first[k])
            while at < len(self.clashes) and self.clashes[at, 0] == hashes[k]:
                if self.clashes[at, 1] == seconds[k]:
                    out[k] = self.settled + at
                at += 1
        todo = np.flatnonzero(~listed)
        for level, (places, words, before) in enumerate(self.levels):
            at = _mix(hashes[todo], level) % U(places)
            word, bit = (at >> U(6)).astype(np.int64), at & U(63)
            hit = ((words[word] >> bit) & U(1)) == 1
            below = np.bitwise_count(words[word] & ((U(1) << bit) - U(1))).astype(np.int64)
            out[todo[hit]] = (before[word] + below)[hit]
            todo = todo[~hit]
        return out


def _fingerprint(seconds: np.ndarray) -> np.ndarray:
    return (_mix(seconds, 63) >> U(32)).astype(np.uint32)


def pack_index(perfect: PerfectHash, slots: np.ndarray) -> bytes:
    """An index file: header, places of each level, bits and ranks of each level, the list of
    clashes, then one entry of fixed width per slot."""
    head = INDEX.pack(INDEX_MAGIC, len(perfect.levels), len(perfect.clashes), perfect.settled, len(slots))
    parts = [head, np.array([p for p, _, _ in perfect.levels], "<u8").tobytes()]
    for _, words, before in perfect.levels:
        parts += [words.astype("<u8").tobytes(), before.astype("<i8").tobytes()]
    return b"".join([*parts, perfect.clashes.astype("<u8").tobytes(), slots.tobytes()])


class IndexFile:
    """Reads of one index file. Bits and ranks are some bits per key of a bucket of bounded size;
    of the entries, few are read one by one by their positions, many at once."""

    def __init__(self, read):
        """``read(offset, n)`` gives n bytes of the file."""
        self._read = read
        magic, levels, clashes, settled, self.keys = INDEX.unpack(read(0, INDEX.size))
        if magic != INDEX_MAGIC:
            raise ValueError("not an index")
        at = INDEX.size
        places = np.frombuffer(read(at, 8 * levels), "<u8").tolist()
        at += 8 * levels
        sizes = [-(-p // 64) for p in places]
        body = np.frombuffer(read(at, 16 * sum(sizes)), "<u8")
        at += 16 * sum(sizes)
        self.perfect = PerfectHash(np.empty(0, U), np.empty(0, U))
        start = 0
        for p, n in zip(places, sizes):
            self.perfect.levels.append((p, body[start : start + n], body[start + n : start + 2 * n].view("<i8")))
            start += 2 * n
        self.perfect.settled = settled
        self.perfect.clashes = np.frombuffer(read(at, 16 * clashes), "<u8").reshape(-1, 2)
        self._entries = at + 16 * clashes

    def entries(self, slots: np.ndarray) -> np.ndarray:
        if len(slots) > FEW:
            return np.frombuffer(self._read(self._entries, self.keys * ENTRY.itemsize), ENTRY)[slots]
        single = (self._read(self._entries + s * ENTRY.itemsize, ENTRY.itemsize) for s in slots.tolist())
        return np.frombuffer(b"".join(single), ENTRY)

    def find(self, hashes: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the index has, and their entries."""
        slots = self.perfect.slots(hashes, seconds)
        asked = np.flatnonzero(slots >= 0)
        found = self.entries(slots[asked])
        known = found["print"] == _fingerprint(seconds[asked])
        there = np.zeros(len(hashes), bool)
        there[asked[known]] = True
        return there, found[known]


# --- Writing ----------------------------------------------------------------------------------------

def _write_shards(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        end = np.array([end_id], tok.kind).tobytes()
        shard = TaskContext.get().partitionId()
        writer, position, last, again = None, 0, object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                writer = _Writer(folder, shard_name(shard))
                writer.write(MAGIC + tok.kind.itemsize.to_bytes(4, "little") + bytes(4))
            ids, places, sizes, numbers = batch.column(0).to_pylist(), [], [], []
            for doc, text in zip(ids, batch.column(1).to_pylist()):
                data = tok.encode(text or "") + end
                writer.write(data)
                again = again + 1 if doc == last else 0
                last = doc
                numbers.append(again)
                places.append(position)
                sizes.append(len(data) // tok.kind.itemsize)
                position += sizes[-1]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(numbers, pa.int64()), pa.array([shard] * len(ids), pa.int64()),
                pa.array(places, pa.int64()), pa.array(sizes, pa.int64()),
            ], names=["doc_id", "copy", "shard", "position", "n_tokens"])
        if writer is not None:
            writer.finish()

    return run


def _write_index(folder: str):
    def run(part: pa.Table) -> pa.Table:
        bucket = part.column("bucket")[0].as_py()
        hashes, seconds = (part.column(c).to_numpy().view(U) for c in ("hash", "second"))
        perfect = PerfectHash(hashes, seconds)
        slots = perfect.slots(hashes, seconds)
        entries = np.zeros(len(slots), ENTRY)
        for name in ("shard", "position", "n_tokens"):
            entries[name][slots] = part.column(name).to_numpy()
        entries["print"][slots] = _fingerprint(seconds)
        writer = _Writer(folder, f"index-{bucket:06d}")
        writer.write(pack_index(perfect, entries))
        writer.finish()
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "keys": pa.array([len(slots)], pa.int64())})

    return run


def _keyed(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds two hashes of the key (doc_id, copy), and its bucket."""
    return rows.withColumns({
        "hash": F.xxhash64("doc_id", "copy"), "second": F.xxhash64(F.lit(1), "doc_id", "copy"),
    }).withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)))


class Store:
    """A written store: its folder, its number of index buckets, its end id."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, tokenizer: str):
        self.spark, self.folder, self.buckets, self.tokenizer = spark, folder, buckets, tokenizer

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(doc_id, copy, shard, position, n_tokens) of keys (doc_id, copy); unknown keys, found
        out by the fingerprint, are left out."""
        folder, kind = self.folder, keys.schema["doc_id"].dataType.simpleString()

        def run(part: pa.Table) -> pa.Table:
            system, root = open_folder(folder)
            path = f"{root}/index-{part.column('bucket')[0].as_py():06d}"
            there, found = np.zeros(part.num_rows, bool), np.zeros(0, ENTRY)
            if system.get_file_info(path).type == fs.FileType.File:  # a bucket without keys has no file
                with system.open_input_file(path) as f:
                    index = IndexFile(lambda offset, n: f.read_at(n, offset))
                    there, found = index.find(*(part.column(c).to_numpy().view(U) for c in ("hash", "second")))
            places = {c: pa.array(found[c].astype(np.int64)) for c in ("shard", "position", "n_tokens")}
            return pa.table({
                "doc_id": part.column("doc_id").filter(pa.array(there)), "copy": part.column("copy").filter(pa.array(there)), **places
            })

        return _keyed(keys.select("doc_id", "copy"), self.buckets).groupBy("bucket").applyInArrow(
            run, f"doc_id {kind}, copy long, shard long, position long, n_tokens long"
        )

    def read(self, found: DataFrame, ids: bool = False) -> DataFrame:
        """Adds ids_crc32 (and the raw ids) to what ``lookup`` found, reading each document's
        range of its shard."""
        folder = self.folder
        kind = {f.name: f.dataType.simpleString() for f in found.schema}
        schema = f"doc_id {kind['doc_id']}, copy long, shard long, position long, n_tokens long, ids_crc32 long"
        if ids:
            schema += ", ids binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = open_folder(folder)
            name, stream, width = None, None, np.dtype("<u2")
            for batch in batches:
                sums, raw = [], []
                for shard, position, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                    if shard != name:
                        if stream is not None:
                            stream.close()
                        name, stream = shard, system.open_input_file(f"{root}/{shard_name(shard)}")
                        head = stream.read_at(HEADER, 0)
                        assert head[:8] == MAGIC, "not a shard"
                        width = np.dtype(f"<u{int.from_bytes(head[8:12], 'little')}")
                    data = stream.read_at(n * width.itemsize, HEADER + position * width.itemsize)
                    sums.append(crc32(data, width))
                    if ids:
                        raw.append(data)
                columns = [*batch.columns, pa.array(sums, pa.int64())]
                names = ["doc_id", "copy", "shard", "position", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
            if stream is not None:
                stream.close()

        return found.repartition("shard").sortWithinPartitions("shard", "position").mapInArrow(run, schema)


def write(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, tokenizer: str = TOKENIZER, folder: str | None = None
) -> tuple[Store, DataFrame]:
    """Writes shards and index; gives the store and its keys (doc_id, copy, shard, n_tokens)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    kind = docs.schema[doc_id].dataType.simpleString()
    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange(
        partitions(spark), F.col("doc_id").asc_nulls_first()
    ).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    entries = materialize(ordered.mapInArrow(
        _write_shards(folder, tokenizer, end_id), f"doc_id {kind}, copy long, shard long, position long, n_tokens long"
    ), "entries")
    buckets = max(1, -(-entries.count() // BUCKET))
    written = _keyed(entries, buckets).groupBy("bucket").applyInArrow(_write_index(folder), "bucket long, keys long")
    written.write.format("noop").mode("overwrite").save()
    return Store(spark, folder, buckets, tokenizer), entries


@query("op4_token_store")
def op4(spark, sf_dir):
    store, entries = write(table(spark, sf_dir, "documents"))
    # Ids in front of a shard: a running sum over one row per shard.
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = entries.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        F.col("shard").alias("s"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")
    )
    read = store.read(store.lookup(entries.select("doc_id", "copy")))
    return read.join(totals, F.col("shard") == F.col("s")).select(
        "doc_id", (F.col("ahead") + F.col("position")).alias("start"), "n_tokens", "ids_crc32"
    )
