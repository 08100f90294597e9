"""Packing into sequences by cutting-stock column generation.

A document's ids are cut every ``capacity`` ids; full pieces are sequences of their own. The
rests, in classes by length, are the orders of a cutting-stock problem with one row per class
(at most CLASSES): the linear program over patterns (how many pieces of each class share a
sequence) is solved by a revised simplex method; knapsack dynamic programming over the duals
prices new patterns, until none is worth more than a sequence. Patterns are rounded down, what
is left is packed by first fit, and the documents, ranked inside their class, are assigned to
the patterns' places.

The program's size is fixed by the number of classes, so the driver's work does not grow with
the corpus. Documents are tokenized once; cut pieces carry their checksum, and only narrow rows
are shuffled. Ranks come from slices with offsets, so a class that holds most documents is
still spread over all tasks.

Defined results: a null text is an empty one, which is a single end id. Repeated rows are
separate documents. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.llm.common import materialize, table, with_rank
from odflux.llm.registry import query
from odflux.llm.tokens import TOKENIZER, crc32, encoder

CAPACITY = 2048
CLASSES = 256
END = 1
GAP = 2e-3


def pieces(docs: DataFrame, doc_id: str, text: str, capacity: int, end_id: int, tokenizer: str, carry_ids: bool) -> DataFrame:
    """One row per piece: where it starts in its document's ids, its length and checksum."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    if carry_ids:
        schema += ", ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        width = tok.kind.itemsize
        end = np.array([end_id], tok.kind).tobytes()
        for batch in batches:
            # Texts are taken in small groups, so the ids of a whole batch are never held.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for i, body in enumerate(part.column(1).to_pylist()):
                    ids = tok.encode(body or "") + end
                    total = len(ids) // width
                    for start in range(0, total, capacity):
                        cut = ids[start * width : (start + capacity) * width]
                        rows.append((i, start, len(cut) // width, crc32(cut, tok.kind), total, cut))
                where, *rest = zip(*rows)
                arrays = [part.column(0).take(pa.array(where, pa.int64()))]
                arrays += [pa.array(c, pa.int64()) for c in rest[:4]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if carry_ids:
                    arrays.append(pa.array(rest[4], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern for one sequence."""
    value, took = np.zeros(room + 1), np.full(room + 1, -1)
    fit = np.searchsorted(sizes, np.arange(room + 1), side="right").tolist()  # sizes ascend
    for w in range(1, room + 1):
        value[w] = value[w - 1]
        if n := fit[w]:
            gain = value[w - sizes[:n]] + worth[:n]
            k = gain.argmax()
            if gain[k] > value[w] + 1e-12:
                value[w], took[w] = gain[k], k
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[took[w]] += 1
            w -= int(sizes[took[w]])
    return float(value[room]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, covering the demand of each size.

    Column generation: the basis starts with patterns of one size each; it ends when the best
    new pattern is worth at most 1 + GAP sequences, which bounds the distance to the optimum.
    """
    m = len(sizes)
    columns = np.diag(room // sizes).astype(float)  # one column per row of the basis
    inverse = np.diag(1.0 / np.diag(columns))
    use = inverse @ demand
    while True:
        duals = inverse.sum(axis=0)
        worth, pattern = _best_pattern(sizes, duals, room)
        if worth <= 1 + GAP:
            break
        d = inverse @ pattern
        ratio = np.where(d > 1e-10, use / np.where(d > 1e-10, d, 1.0), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        use = np.maximum(use - ratio[r] * d, 0.0)
        use[r] = ratio[r]
        inverse[r] /= d[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(d[others], inverse[r])
        columns[:, r] = pattern
    whole = np.floor(use + 1e-9).astype(np.int64)
    patterns, counts = [], []
    left = demand.astype(np.int64).copy()
    for k in range(m):
        p = columns[:, k].astype(np.int64)
        if whole[k]:
            patterns.append(p), counts.append(int(whole[k]))
            left -= p * whole[k]
    # What rounding left over: first fit, largest first; at most a few sequences per class.
    left = np.maximum(left, 0)
    while left.any():
        p, free = np.zeros(m, np.int64), room
        for k in np.argsort(-sizes, kind="stable"):
            n = min(int(left[k]), free // int(sizes[k]))
            p[k] += n
            free -= n * int(sizes[k])
        times = int(min(left[p > 0] // p[p > 0]))
        patterns.append(p), counts.append(times)
        left -= p * times
    return np.array(patterns, np.int64).reshape(-1, m), np.array(counts, np.int64)


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END,
    tokenizer: str = TOKENIZER, carry_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece, and the
    packed ids with ``carry_ids``. Sequences are filled from offset 0 without gaps."""
    unit = -(-capacity // CLASSES)
    cut = materialize(pieces(docs, doc_id, text, capacity, end_id, tokenizer, carry_ids), "pieces")
    cut = cut.withColumn("class", F.ceil(F.col("length") / F.lit(unit)).cast("int"))
    counts = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count("*").alias("n")).collect()}
    room = capacity // unit
    sizes = np.array(sorted(counts), np.int64)
    table_: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
    if len(sizes):
        patterns, times = solve_patterns(sizes, np.array([counts[s] for s in sizes.tolist()], float), room)
        first = np.cumsum(times) - times
        for k, s in enumerate(sizes.tolist()):
            used = np.flatnonzero(patterns[:, k])
            places = patterns[used, k] * times[used]
            table_[s] = (np.cumsum(places) - places, patterns[used, k], first[used], used)
    ranked = with_rank(cut, ["class"], ["doc_id", "start", "ids_crc32"], "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "class")
    names = [f.name for f in cut.schema if f.name != "class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sort, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("class", "rank"))
            sequence = np.zeros(len(sort), np.int64)
            for s in np.unique(sort):
                begin, each, base, _ = table_[int(s)]
                here = np.flatnonzero(sort == s)
                k = np.searchsorted(begin, rank[here], side="right") - 1
                sequence[here] = base[k] + (rank[here] - begin[k]) // each[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(sequence)], names=[*names, "sequence_id"]
            )

    placed = ranked.mapInArrow(run, schema + ", sequence_id long")
    # A sequence has at most ``capacity`` pieces.
    ahead = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))


@query("op8_packing")
def op8(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
