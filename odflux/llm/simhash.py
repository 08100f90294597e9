"""Near-duplicates by SimHash: a self-join of fingerprints in binary tries.

A fingerprint has one or more 64-bit words; a bit is set if it is set in more than half of the
shingles' hashes. ``tables`` of ``bits`` bits each are searched: two fingerprints link in a
table if they differ in at most ``budget`` of its bits.

Search in a table: a pair within the budget agrees in one of ``budget + 1`` bit blocks, so all
fingerprints with an equal block make one unit, whose remaining bits form a binary trie. Pairs
of trie nodes are traversed together, level by level; differing bits add up, and a pair beyond
the budget is dropped with all below it. A unit of more than ``LEAF`` fingerprints is first
split by the next bits into units of node pairs, again and again, so no task holds an unbounded
unit. A unit emits a minimum spanning forest of its links, never all of its pairs, so what is
emitted grows with the fingerprints. Equal texts and equal fingerprints are one node.

Defined results: null and empty texts have no words and fingerprint zero. Rows without an id
count, but never name a component; a component of such rows alone has none. Repeated rows are
equal fingerprints. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.llm.common import batch_of, materialize, row_bytes, table
from odflux.llm.components import components
from odflux.llm.registry import query

SEED = 42
LEAF = 2048  # fingerprints of a unit that one task may hold
STRIDE = 6  # bits by which a larger unit is split
_SLICE = 1 << 20  # shingles counted at once

U = np.uint64


def _bit_sums(hashes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How often each of the 64 bits is set, per document: byte histograms times byte bits."""
    lanes = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64)
    codes = (doc[:, None] * 8 + np.arange(8)) * 256 + lanes
    counts = np.bincount(codes.ravel(), minlength=docs * 2048).reshape(docs, 8, 256)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return (counts @ bits.astype(np.int64)).reshape(docs, 64)


def _spread(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hash for word k of a fingerprint: word 0 is the hash itself."""
    if word == 0:
        return hashes
    x = hashes + U(word * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_hashes(text: memoryview, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, joined by a space; A-Z are lower-cased."""
    parts = bytes(text).lower().split()
    if not parts:
        return np.empty(0, U)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], U)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[: -words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], U)


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, length: int = 1, distinct: bool = False
) -> DataFrame:
    """(doc_id, digest, node, sig, n): XXH64 of the text, the node it belongs to, its fingerprint
    as big-endian bytes, and the number of shingles. ``distinct`` counts each shingle of a text
    once."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((batch.num_rows, 64 * length), np.int64)
            sizes = np.zeros(batch.num_rows, np.int64)
            digests = np.zeros(batch.num_rows, U)
            held, owner, first, count = [], [], 0, 0

            def count_held(upto: int) -> None:
                if held:
                    hashes, who = np.concatenate(held), np.concatenate(owner)
                    for at in range(0, len(hashes), _SLICE):
                        part, doc = hashes[at : at + _SLICE], who[at : at + _SLICE] - first
                        for k in range(length):
                            sums[first:upto, 64 * k : 64 * k + 64] += _bit_sums(_spread(part, k), doc, upto - first)

            for i, body in enumerate(row_bytes(batch.column(1))):
                digests[i] = xxhash.xxh64_intdigest(body, SEED)
                found = shingle_hashes(body, words)
                if distinct:
                    found = np.unique(found)
                sizes[i] = len(found)
                held.append(found)
                owner.append(np.full(len(found), i))
                count += len(found)
                if i - first >= 127 or count > _SLICE:
                    count_held(i + 1)
                    held, owner, first, count = [], [], i + 1, 0
            count_held(batch.num_rows)
            bits = 2 * sums > sizes[:, None]
            # Bit 63 of a word comes first, so that bytes read as unsigned big-endian numbers.
            packed = np.packbits(bits.reshape(-1, length, 64)[:, :, ::-1].reshape(-1, 64 * length), axis=1)
            raw = packed.tobytes()
            step = 8 * length
            sig = pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())
            if length == 1:
                node = pa.array(packed.view(">i8").reshape(-1).astype(np.int64))
            else:
                node = pa.array(np.array(
                    [xxhash.xxh64_intdigest(s.as_py(), n) for s, n in zip(sig, sizes.tolist())], U
                ).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests.view(np.int64)), node, sig, pa.array(sizes)],
                names=["doc_id", "digest", "node", "sig", "n"],
            )

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, digest long, node long, sig binary, n long")


# --- The trie self-join inside one task ------------------------------------------------------

def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges of these sizes, one after the other, and the sizes."""
    return np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), size


def trie_links(
    v: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, err: np.ndarray, budget: int, depth: int,
    every: bool = False,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j, differing bits) between positions of ``v``.

    ``v`` holds left-aligned bit strings, sorted inside each range. Each root is a pair of
    ranges that share no bit yet looked at; a range with itself is a self-join. Equal strings
    are joined by a path, or all with each other if links are still to be judged (``every``).
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(depth + 1):
        own = a0 == b0
        if d == depth:
            break
        single = ~own & (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            e = err[single] + np.bitwise_count((v[i] ^ v[j]) << U(d)).astype(np.int64)
            near = e <= budget
            out.append((i[near], j[near], e[near]))
        go = ~single
        a0, a1, b0, b1, err, own = (x[go] for x in (a0, a1, b0, b1, err, own))
        if not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum(((v >> U(63 - d)) & U(1)).astype(np.int64))))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        cross = ~own
        left = [
            np.concatenate(x) for x in (
                (a0, am, a0[cross], am[cross]), (am, a1, am[cross], a1[cross]),
                (b0, bm, bm[cross], b0[cross]), (bm, b1, b1[cross], bm[cross]),
                (err, err, err[cross] + 1, err[cross] + 1),
            )
        ]
        # A self-join's two halves meet once, with one more differing bit.
        left = [np.concatenate((x, y)) for x, y in zip(left, (a0[own], am[own], am[own], a1[own], err[own] + 1))]
        a0, a1, b0, b1, err = left
        keep = (err <= budget) & (a1 > a0) & (b1 > b0) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, err = a0[keep], a1[keep], b0[keep], b1[keep], err[keep]
    if len(a0) and every:
        wide = b1 - b0
        i, size = _ranges(a0, (a1 - a0) * wide)
        within = i - np.repeat(a0, size)
        i = np.repeat(a0, size) + within // np.repeat(wide, size)
        j = np.repeat(b0, size) + within % np.repeat(wide, size)
        ok = np.repeat(a0 != b0, size) | (i < j)
        out.append((i[ok], j[ok], np.repeat(err, size)[ok]))
    elif len(a0):
        # No bits are left: all strings of a range are equal, and a path joins them.
        own = a0 == b0
        out.append((a0[~own], b0[~own], err[~own]))
        first, size = _ranges(a0[own], (a1 - a0 - 1)[own])
        out.append((first, first + 1, np.repeat(err[own], size)))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out))


def forest(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the links of a minimum spanning forest: each round, every component takes
    its lightest link to another one."""
    order = np.argsort(w, kind="stable")
    i, j = i[order], j[order]
    rank, label, chosen = np.arange(len(i)), np.arange(n), []
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b, rank = i[apart], j[apart], a[apart], b[apart], rank[apart]
        if not len(i):
            break
        best = np.full(n, len(i))
        here = np.arange(len(i))
        np.minimum.at(best, a, here)
        np.minimum.at(best, b, here)
        took = np.unique(best[best < len(i)])
        chosen.append(rank[took])
        a, b = a[took], b[took]
        while True:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label[a] == label[b]).all():
                break
        while not np.array_equal(label, label[label]):
            label = label[label]
    return order[np.concatenate(chosen)] if chosen else np.empty(0, np.int64)


# --- Units across tasks ----------------------------------------------------------------------

_UNIT = "unit long, side byte, err byte, bits byte, value long, node long, spare long, more long"
_COLUMNS = [c.split()[0] for c in _UNIT.split(", ")]
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _mix(*parts) -> np.ndarray:
    x = np.zeros(1, U)
    for k, part in enumerate(parts):
        x = _spread(x ^ np.asarray(part).astype(U), k + 1)
    return x


def _units(tables: int, bits: int, budget: int):
    """Each fingerprint once per table and block: the block names the unit, the rest is searched."""
    cuts = [bits * k // (budget + 1) for k in range(budget + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy(zero_copy_only=False)
            spare = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").astype(U).reshape(batch.num_rows, -1)
            for t in range(tables):
                at = t * bits  # tables do not cross the words of a fingerprint
                word = (raw[:, at // 64] >> U(64 - bits - at % 64)) & U((1 << bits) - 1)
                for k in range(budget + 1):
                    low, size = bits - cuts[k + 1], cuts[k + 1] - cuts[k]
                    block = (word >> U(low)) & U((1 << size) - 1)
                    upper = (word >> U(low + size)) << U(low) if cuts[k] else np.zeros_like(word)
                    rest = upper | (word & U((1 << low) - 1))
                    n = len(node)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(_mix(block, t * 64 + k).view(np.int64)), pa.array(np.zeros(n, np.int8)),
                        pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, bits - size, np.int8)),
                        pa.array(rest.view(np.int64)), pa.array(node), *map(pa.array, spare.T.copy()),
                    ], names=_COLUMNS)

    return run


def _split(budget: int):
    """The points of too large units, by pairs of the next STRIDE bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, side, err, bits, value, node, *spare = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            step = np.minimum(bits, STRIDE)
            value = value.view(U)
            head = (value >> (bits - step).astype(U)).astype(np.int64)
            rest = value & ((U(1) << (bits - step).astype(U)) - U(1))
            for mask in range(1 << STRIDE):
                more = mask.bit_count()
                ok = (err + more <= budget) & (mask < (1 << step.astype(np.int64)))
                if not ok.any():
                    continue
                h, other, s = head[ok], head[ok] ^ mask, side[ok]
                # side 0: joined with itself; 1 and 2: the two sides of a pair of nodes
                first = np.where(s == 0, np.minimum(h, other), np.where(s == 1, h, other))
                second = np.where(s == 0, np.maximum(h, other), np.where(s == 1, other, h))
                new = s if mask == 0 else np.where(s == 0, np.where(h < other, 1, 2), s)
                name = _mix(unit[ok].view(U), first, second).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(name), pa.array(new.astype(np.int8)), pa.array((err[ok] + more).astype(np.int8)),
                    pa.array((bits[ok] - step[ok]).astype(np.int8)), pa.array(rest[ok].view(np.int64)), pa.array(node[ok]),
                    *[pa.array(x[ok]) for x in spare],
                ], names=_COLUMNS)

    return run


def _search(budget: int, apart: int):
    """Spanning links of the units in a partition, which comes sorted by unit and side. Links
    whose spare bits differ in more than ``apart`` are dropped before the forest is made."""

    def solve(block: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, side, err, bits, value, node, *spare = (c.to_numpy() for c in block.columns)
        v = value.view(U) << (64 - bits).astype(U)
        v = np.where(bits == 0, U(0), v)
        order = np.lexsort((v, side, unit))
        unit, side, err, v, node = (x[order] for x in (unit, side, err, v, node))
        spare = np.stack([x.view(U)[order] for x in spare], axis=1)
        depth = int(bits.max(initial=0))
        starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        ends = np.append(starts[1:], len(unit))
        # A few thousand units at a time keep the frontier of node pairs small.
        weight = np.cumsum((ends - starts) ** 2)
        for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(weight // (1 << 22))) + 1):
            if not len(part):
                continue
            lo, hi = starts[part], ends[part]
            seconds = np.concatenate(([0], np.cumsum(side == 2)))
            mid = hi - (seconds[hi] - seconds[lo])
            two = side[lo] > 0
            usable = np.where(two, (mid > lo) & (hi > mid), hi - lo > 1)
            lo, hi, mid, two = lo[usable], hi[usable], mid[usable], two[usable]
            base = int(lo[0]) if len(lo) else 0
            top = int(hi[-1]) if len(hi) else 0
            i, j, w = trie_links(
                v[base:top], lo - base, np.where(two, mid, hi) - base, np.where(two, mid, lo) - base, hi - base,
                err[lo].astype(np.int64), budget, depth, apart < 128,
            )
            more = np.bitwise_count(spare[base:top][i] ^ spare[base:top][j]).sum(axis=1, dtype=np.int64)
            near = more <= apart
            # Spare bits weigh as well, so that the forest joins what is most alike.
            i, j, w = i[near], j[near], (w + more)[near]
            if len(i):
                names, place = np.unique(node[base:top], return_inverse=True)
                i, j = place[i], place[j]
                took = forest(len(names), i, j, w)
                yield batch_of(_EDGE, [names[i[took]], names[j[took]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            last = batch.column(0)[-1].as_py()
            if rows < 200_000 or batch.column(0)[0].as_py() == last:
                continue
            block = pa.Table.from_batches(held)
            cut = int(np.searchsorted(block.column("unit").to_numpy(), last))
            yield from solve(block.slice(0, cut))
            held, rows = block.slice(cut).to_batches(), block.num_rows - cut
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def links(nodes: DataFrame, tables: int = 1, bits: int = 64, budget: int = 2, apart: int = 128) -> DataFrame:
    """Spanning links (u, v) of distinct fingerprints ``nodes`` (node, sig, and sixteen bytes
    ``spare``, which may differ in ``apart`` bits)."""
    assert 64 % bits == 0
    units = nodes.select("node", "sig", "spare").mapInArrow(_units(tables, bits, budget), _UNIT)
    found = None
    while True:
        units = materialize(units, "units")
        sizes = units.groupBy("unit").agg(F.count("*").alias("size"), F.max("bits").alias("left"))
        sizes = materialize(sizes.where("size > 1"), "sizes")
        small = units.join(sizes.where((F.col("size") <= LEAF)).select("unit"), "unit")
        edges = (
            small.select(*_COLUMNS)
            .repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_search(budget, apart), "u long, v long")
        )
        # With no bits left all members are equal: one star, by partial minima.
        equal = sizes.where((F.col("size") > LEAF) & (F.col("left") == 0)).select("unit")
        star = units.join(equal, "unit")
        star = star.join(star.groupBy("unit").agg(F.min("node").alias("u")), "unit").select("u", F.col("node").alias("v"))
        edges = materialize(edges.union(star), "links")
        found = edges if found is None else found.union(edges)
        large = sizes.where((F.col("size") > LEAF) & (F.col("left") > 0)).select("unit")
        if large.isEmpty():
            return found
        units = units.join(large, "unit").select(*_COLUMNS).mapInArrow(_split(budget), _UNIT)


# --- Groups -----------------------------------------------------------------------------------

def groups(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds root, the same for all linked fingerprints, and component_id, their smallest doc_id."""
    first = materialize(marked.groupBy("node").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(edges)
    named = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(named.join(least, "root").select("node", "root", "component_id"), "named")
    return marked.join(named, "node")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """Groups by 64-bit fingerprints that differ in at most ``budget`` bits, transitively."""
    marked = materialize(fingerprints(docs, doc_id, text, words), "fingerprints")
    nodes = marked.groupBy("node").agg(F.first("sig").alias("sig")).withColumn("spare", F.lit(bytes(16)))
    return groups(marked, links(nodes, budget=budget))


def keepers(grouped: DataFrame) -> DataFrame:
    """(doc_id, digest) of the one document that stays of each group: the smallest id."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    return grouped.groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.digest")


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("sig")).alias("fingerprint"), "component_id")
