"""Vector codes: each part of a vector is replaced by the number of its nearest codebook entry.

Components are whole numbers, floor(scale * x). One pass cuts the kept vectors into runs of a
bounded number of components. Inside a run, the parts at one position are put in the order of a
Hilbert curve and cut into flat blocks of BLOCK neighbours, and each block stores the box of its
smallest and largest components and their sums. Runs are written once; every round reads them
again, without a shuffle of vectors.

In a round, the distances from a block's box to the entries bound all distances in the block: an
entry whose nearest possible distance is above the smallest farthest one cannot win and leaves
the block's shortlist. A block with one entry left goes to it as a whole, by its stored sums; the
others are evaluated against their shortlist by integer kernels (in doubles where all values stay
below 2^53, which is exact). A task sends one sum per part position, entry and component,
whatever it has read; the driver holds codebooks only, entries times width numbers.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped;
an empty table gives no rows. Shorter vectors count as ending in zeros, and the width is the
largest kept length, rounded up to a multiple of the number of parts. A row without an id is
coded like others and comes last where entries are chosen; rows with equal ids are told apart by
their components there, and equal rows get equal codes. With fewer vectors than entries, the
codebook is shorter. Ties go to the lower entry. Null labels are one label. Other columns are not
read. Components of 2^40 or more in size are refused, since sums of their squares overflow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.llm.common import materialize, table
from odflux.llm.registry import query

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 32  # parts of a block
RUN = 1 << 19  # components of a run
LARGEST = 1 << 40


# --- Vectors ------------------------------------------------------------------------------------------

def whole_numbers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, lengths, flat components) of a column of lists."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False)  # null components become nan
    start = np.concatenate(([0], np.cumsum(lengths)))
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    kept = (lengths > 0) & (wrong[start[1:]] == wrong[start[:-1]])
    x = np.floor(x[np.repeat(kept, lengths)] * scale)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST} and more after scaling have no exact code")
    return np.flatnonzero(kept), lengths[kept], x.astype(np.int64)


def padded(lengths: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _survey(entries: int, scale: int):
    """Of each task, the first rows by id and the longest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        longest = 0
        for batch in batches:
            rows, lengths, flat = whole_numbers(batch.column(1), scale)
            if not len(rows):
                continue
            longest = max(longest, int(lengths.max()))
            ids = batch.column(0).to_pylist()
            at = np.concatenate(([0], np.cumsum(lengths)))
            wanted = sorted(range(len(rows)), key=lambda k: (ids[rows[k]] is None, ids[rows[k]] or 0))
            if len(wanted) > entries:  # with all rows of the last id, which may repeat
                last = ids[rows[wanted[entries - 1]]]
                wanted = [k for j, k in enumerate(wanted) if j < entries or ids[rows[k]] == last]
            new = [(ids[rows[k]] is None, ids[rows[k]] or 0, flat[at[k] : at[k + 1]].tolist()) for k in wanted]
            best = sorted(best + new)[:entries]
        yield pa.RecordBatch.from_arrays([
            pa.array([None if missing else i for missing, i, _ in best], pa.int64()),
            pa.array([v for _, _, v in best], pa.list_(pa.int64())), pa.array([longest] * len(best), pa.int64()),
        ], names=["vec_id", "v", "longest"])

    return run


# --- Runs of Hilbert-sorted blocks --------------------------------------------------------------------

def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates below 2^bits."""
    axes = [points[:, k].copy() for k in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(len(axes)):
            high = (axes[k] & q) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[k]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            if k:
                axes[k] = axes[k] ^ swap
        q >>= 1
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    turn = np.zeros(len(points), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(axes[-1] & q, q - 1, 0)
        q >>= 1
    place = np.zeros(len(points), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            place = (place << 1) | (((axis ^ turn) >> bit) & 1)
    return place


def curve_order(x: np.ndarray) -> np.ndarray:
    """The rows of x along a Hilbert curve through their widest dimensions."""
    low, high = x.min(axis=0), x.max(axis=0)
    wide = np.argsort(low - high, kind="stable")[:15]
    bits = max(1, min(10, 60 // len(wide)))
    span = np.maximum(high - low, 1)[wide]
    cells = ((x[:, wide] - low[wide]) * ((1 << bits) - 1)) // span
    return np.argsort(hilbert(cells, bits), kind="stable")


class Blocks:
    """The parts of a run at one position: sorted, cut into blocks, with boxes and sums."""

    def __init__(self, x: np.ndarray):
        self.n, self.width = x.shape
        pad = -self.n % BLOCK
        cube = np.concatenate((x, np.repeat(x[-1:], pad, axis=0))).reshape(-1, BLOCK, self.width)
        self.cube, self.low, self.high = cube, cube.min(axis=1), cube.max(axis=1)
        self.sums = cube.sum(axis=1)
        self.sizes = np.full(len(cube), BLOCK)
        if pad:
            self.sums[-1] -= pad * x[-1]
            self.sizes[-1] -= pad

    def dump(self) -> bytes:
        return b"".join(a.astype(np.int64).tobytes() for a in (self.cube, self.low, self.high, self.sums))

    @classmethod
    def load(cls, data: bytes, n: int, width: int) -> Blocks:
        self = cls.__new__(cls)
        self.n, self.width = n, width
        blocks = -(-n // BLOCK)
        numbers = np.frombuffer(data, np.int64)
        cut = np.split(numbers, np.cumsum([blocks * BLOCK * width, blocks * width, blocks * width]))
        self.cube = cut[0].reshape(blocks, BLOCK, width)
        self.low, self.high, self.sums = (c.reshape(blocks, width) for c in cut[1:])
        self.sizes = np.full(blocks, BLOCK)
        self.sizes[-1] = n - (blocks - 1) * BLOCK
        return self

    def shortlists(self, codebook: np.ndarray) -> np.ndarray:
        """(blocks, entries): whether an entry can be the nearest of a part in the block."""
        out = np.empty((len(self.cube), len(codebook)), bool)
        step = max(1, (1 << 20) // codebook.size)
        for at in range(0, len(out), step):
            low, high = self.low[at : at + step, None, :], self.high[at : at + step, None, :]
            gap = np.maximum(np.maximum(low - codebook, codebook - high), 0)
            far = np.maximum(codebook - low, high - codebook)
            nearest, farthest = (gap * gap).sum(axis=2), (far * far).sum(axis=2)
            out[at : at + step] = nearest <= farthest.min(axis=1)[:, None]
        return out

    def assign(self, codebook: np.ndarray, distances: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
        """(codes, squared distances, distances evaluated), per block and place. Without
        ``distances``, blocks with one entry left are not evaluated."""
        short = self.shortlists(codebook)
        left = short.sum(axis=1)
        codes = np.zeros(self.cube.shape[:2], np.int64)
        found = np.zeros(self.cube.shape[:2], np.int64)
        if not distances:
            codes[left == 1] = short[left == 1].argmax(axis=1)[:, None]
        largest = max(np.abs(self.low).max(), np.abs(self.high).max(), np.abs(codebook).max())
        kind = np.float64 if 4.0 * float(largest) ** 2 * self.width < 2.0**52 else np.int64
        entries = codebook.astype(kind)
        norms = (entries * entries).sum(axis=1)
        evaluated = 0
        size = 1
        while size // 2 < len(codebook):
            chosen = np.flatnonzero((left > size // 2) & (left <= size) & (distances | (left > 1)))
            size = min(size, len(codebook))
            step = max(1, (1 << 19) // (BLOCK * max(size, self.width)))
            for at in range(0, len(chosen), step):
                blocks = chosen[at : at + step]
                lists = np.argsort(~short[blocks], axis=1, kind="stable")[:, :size]  # ascending entries
                x = self.cube[blocks].astype(kind)
                s = norms[lists][:, None, :] - 2 * np.matmul(x, entries[lists].transpose(0, 2, 1))
                none = np.arange(size) >= left[blocks][:, None]
                s = np.where(none[:, None, :], np.inf if kind is np.float64 else np.iinfo(np.int64).max, s)
                best = s.argmin(axis=2)
                codes[blocks] = np.take_along_axis(lists, best.reshape(len(blocks), -1), 1).reshape(best.shape)
                nearest = np.take_along_axis(s, best[:, :, None], 2)[:, :, 0] + (x * x).sum(axis=2)
                found[blocks] = nearest.astype(np.int64)
                evaluated += int(left[blocks].sum()) * BLOCK
            size *= 2
        return codes, found, evaluated

    def totals(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sums of the parts of each entry."""
        counts = np.zeros(len(codebook), np.int64)
        sums = np.zeros(codebook.shape, np.int64)
        codes, _, _ = self.assign(codebook, distances=False)
        whole = (codes == codes[:, :1]).all(axis=1)
        np.add.at(counts, codes[whole, 0], self.sizes[whole])
        np.add.at(sums, codes[whole, 0], self.sums[whole])
        there = np.arange(BLOCK) < self.sizes[~whole][:, None]
        mixed, x = codes[~whole][there], self.cube[~whole][there]
        if len(mixed):
            order = np.argsort(mixed, kind="stable")
            entry, start = np.unique(mixed[order], return_index=True)
            counts[entry] += np.diff(np.append(start, len(mixed)))
            sums[entry] += np.add.reduceat(x[order], start, axis=0)
        return counts, sums


def _cut_runs(width: int, parts: int, scale: int, kind: pa.DataType):
    """One row per run: ids, labels, and each position's order and blocks."""
    limit = max(BLOCK, RUN // width)

    def flush(ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        x, ids, labels = np.concatenate(vectors), pa.concat_arrays(ids), pa.concat_arrays(labels)
        orders, blocks = [], []
        for part in np.split(x, parts, axis=1):
            order = curve_order(part)
            orders.append(order.astype(np.int32).tobytes())
            blocks.append(Blocks(part[order]).dump())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, labels)]
        return pa.RecordBatch.from_arrays([
            *lists, pa.array([orders], pa.list_(pa.binary())), pa.array([blocks], pa.list_(pa.binary())),
        ], names=["ids", "labels", "orders", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, held = [], [], [], 0
        for batch in batches:
            rows, lengths, flat = whole_numbers(batch.column(1), scale)
            x, at = padded(lengths, flat, width), 0
            while at < len(rows):
                take = rows[at : at + limit - held]
                ids.append(batch.column(0).take(pa.array(take)))
                labels.append(batch.column(2).take(pa.array(take)).cast(kind))
                vectors.append(x[at : at + len(take)])
                at, held = at + len(take), held + len(take)
                if held == limit:
                    yield flush(ids, labels, vectors)
                    ids, labels, vectors, held = [], [], [], 0
        if held:
            yield flush(ids, labels, vectors)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(batch, row, n, orders, blocks) of each run, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            n = len(batch.column("ids")[k])
            orders = [np.frombuffer(o.as_buffer(), np.int32) for o in batch.column("orders")[k].values]
            yield batch, k, n, orders, [Blocks.load(b.as_buffer(), n, width) for b in batch.column("blocks")[k].values]


def _gather(codebooks: np.ndarray):
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(codebooks.shape, np.int64)
        for _, _, _, _, blocks in _unpacked(batches, width):
            for k, block in enumerate(blocks):
                more, added = block.totals(codebooks[k])
                counts[k] += more
                sums[k] += added
        part, entry = np.nonzero(counts)
        place = np.tile(np.arange(width), len(part))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(part, width)), pa.array(np.repeat(entry, width)), pa.array(place),
            pa.array(np.repeat(counts[part, entry], width)), pa.array(sums[part, entry].ravel()),
        ], names=["part", "entry", "place", "n", "total"])

    return run


def _encode(codebooks: np.ndarray, id_kind: pa.DataType, label_kind: pa.DataType):
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, n, orders, blocks in _unpacked(batches, width):
            codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts):
                code, far, _ = blocks[p].assign(codebooks[p])
                codes[orders[p], p] = code.ravel()[:n]
                error[orders[p]] += far.ravel()[:n]
            digits = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([
                batch.column("ids")[k].values.cast(id_kind), batch.column("labels")[k].values.cast(label_kind),
                pa.array([digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)], pa.string()),
                pa.array(error),
            ], names=["vec_id", "label", "code", "error"])

    return run


# --- The operator -------------------------------------------------------------------------------------

def _split(vectors: list[list[int]], width: int, parts: int) -> np.ndarray:
    """(parts, entries, width of a part) of the first vectors."""
    x = padded(np.array([len(v) for v in vectors]), np.array([c for v in vectors for c in v], np.int64), width)
    return np.stack(np.split(x, parts, axis=1))


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of every usable vector, and the codebooks (parts, entries,
    width of a part); no codebooks if there is no vector. At most 256 entries."""
    assert 0 < entries <= 256 and parts > 0
    spark = rows.sparkSession
    read = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    label_type = read.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label_type}, code string, error long"
    first = materialize(read.select("vec_id", "v").mapInArrow(
        _survey(entries, scale), "vec_id long, v array<long>, longest long"
    ), "first")
    longest = first.agg(F.max("longest")).first()[0]
    if longest is None:
        return spark.createDataFrame([], schema), None
    width = -(-longest // parts) * parts
    chosen = first.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    codebooks = _split([list(row.v) for row in chosen], width, parts)

    arrow = spark.createDataFrame([], f"label {label_type}").toArrow().schema.field("label").type
    runs = materialize(read.mapInArrow(
        _cut_runs(width, parts, scale, arrow),
        f"ids array<long>, labels array<{label_type}>, orders array<binary>, blocks array<binary>",
    ), "runs")
    for _ in range(rounds):
        found = runs.mapInArrow(_gather(codebooks), "part long, entry long, place long, n long, total long")
        totals = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        codebooks = codebooks.copy()
        for part, entry, place, n, total in totals.collect():  # entries times width numbers
            codebooks[part, entry, place] = total // n
    return runs.mapInArrow(_encode(codebooks, pa.int64(), arrow), schema), codebooks


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the error summed over equal labels; null labels are one."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    return coded.join(sums, coded["label"].eqNullSafe(sums["l"])).drop("l")


_ROUND = """
, a{k} as (
  select p.part, p.n, p.x, min(64 * list_sum([(p.x[i] - c.x[i]) * (p.x[i] - c.x[i]) for i in range(1, len(p.x) + 1)]) + c.entry) as best
  from p join c{k} c on p.part = c.part group by p.part, p.n, p.x
)"""
_MOVE = """
, s{k} as (
  select part, entry, i, cast(floor(sum(x[i]) / count(*)) as bigint) as x
  from (select part, x, best % 64 as entry, unnest(range(1, len(x) + 1)) as i from a{k}) group by part, entry, i
), c{next} as (
  select c.part, c.entry, coalesce(m.x, c.x) as x
  from c{k} c left join (select part, entry, list(x order by i) as x from s{k} group by part, entry) m
  on c.part = m.part and c.entry = m.entry
)"""
ORACLE = """
with v as (
  select vec_id, label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), w as (
  select *, row_number() over (order by vec_id nulls last, e) as n, len(e) // 16 as size from v
), p as (
  select n, part, e[part * size + 1 : (part + 1) * size] as x from (select *, unnest(range(16)) as part from w)
), c0 as (
  select part, n - 1 as entry, x from p where n <= 64
)""" + _ROUND.format(k=0) + _MOVE.format(k=0, next=1) + _ROUND.format(k=1) + _MOVE.format(k=1, next=2) + _ROUND.format(k=2) + """
, coded as (
  select n, string_agg(printf('%02x', cast(best % 64 as integer)), '' order by part) as code,
         cast(sum(best // 64) as bigint) as error
  from a2 group by n
), books as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from c2
), labels as (
  select label, cast(sum(error) as bigint) as label_error from coded join w using (n) group by label
)
select w.vec_id, code, error, label_error, codebooks_sha256
from coded join w using (n) join labels on w.label is not distinct from labels.label cross join books
"""


@query("op11_vector_codes", ORACLE)
def op11(spark, sf_dir):
    coded, codebooks = compress(table(spark, sf_dir, "embeddings"))
    coded = with_label_error(materialize(coded, "coded"))
    sha = digest(codebooks) if codebooks is not None else None
    return coded.select("vec_id", "code", "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))
