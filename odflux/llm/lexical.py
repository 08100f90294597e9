"""Ranked lexical search over hashed max-sketches.

One pass cuts every text into terms and writes the index, one row per document: its number of
terms, a sketch, and its terms with their counts. The sketch is an array of at least SPREAD cells
per different term; a term's hash names a cell, and a cell keeps the largest count folded into it.
A term's impact in a document grows with its count alone, so a cell's count gives the largest
impact in it under any corpus statistics, and the index does not depend on the queries.

The number of documents and terms come from the index, and so do document frequencies, counted
over all terms with map-side sums; only then are the query's terms joined to them. Queries are
cut into blocks of a bounded number of items and (item, term) pairs; a block goes to the tasks as
a whole, and the index is read once or twice per block:

1. The sketches alone are read. Looking up a block's terms for a batch of documents is one product
   of matrices, cells by weights, whose sums are upper bounds of all scores. Each task keeps the k
   highest bounds of each item; the k highest over all tasks are scored exactly, and the k-th of
   these scores is the item's first threshold.
2. Each task takes its documents in descending order of bound and scores them exactly, in whole
   numbers, until no bound reaches the threshold, which rises to the k-th score found so far. It
   returns at most k rows per item, and a window over these ranks them.

Nothing is sent per pair of item and document, and no group is collected: hot terms, equal texts
and long documents only make rows of the index, whose size is that of the document's own terms.

Defined results: a null text has no term and is no document of the statistics; nor is an empty
one. An item without terms has no results. Repeated rows are documents of their own, and rows
with equal scores and ids come in any order. A null doc_id comes after others on ties. Repeated
item ids are told apart by a number of their own, so each row's results come whole, under the
same id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.llm.common import materialize, row_bytes, table, with_rank
from odflux.llm.registry import query

SPREAD = 32  # cells per different term
BLOCK_PAIRS = 1 << 16  # (item, term) pairs of a query block; an item counts as 256 at least
LOW, SCALE = 25, 1_000_000_000  # a document's m is LOW + 75 * n / average n
EXACT = 160  # counts up to here have a cell value of their own
EPS = 1.2e-7  # of single precision, in which bounds are summed
HELD = 1 << 22  # bytes of index rows or of terms that are held together
_TERM = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _TERM else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case."""
    return text.translate(_TABLE).split()


# --- Index --------------------------------------------------------------------------------------------

def _cells(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte, rounded up: exact up to EXACT, then steps of an eighth of a doubling."""
    steps = np.ceil(8 * np.log2(np.maximum(counts, 1) / EXACT) - 1e-9)
    return np.where(counts <= EXACT, counts, np.minimum(EXACT + np.maximum(steps, 1), 255)).astype(np.uint8)


def _cell_counts() -> np.ndarray:
    """The largest count a byte may stand for; the last one stands for all beyond."""
    value = np.arange(256)
    out = np.where(value <= EXACT, value, np.floor(EXACT * 2.0 ** ((value - EXACT) / 8) + 1e-6)).astype(np.float64)
    out[255] = np.inf
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "width", "sketch", "terms", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for doc_id, text in zip(batch.column(0).to_pylist(), row_bytes(batch.column(1))):
            found = Counter(terms_of(bytes(text)))
            if not found:
                continue
            counts = np.fromiter(found.values(), np.int64, len(found))
            width = 64
            while width < SPREAD * len(found):
                width *= 2
            place = np.fromiter(map(zlib.crc32, found), np.int64, len(found)) & (width - 1)
            sketch = np.zeros(width, np.uint8)
            np.maximum.at(sketch, place, _cells(counts))
            packed = pa.compress(sketch.tobytes(), codec="zstd", asbytes=True)
            words = b" ".join(found).decode()
            rows.append((doc_id, int(counts.sum()), width, packed, words, counts.astype(np.int32).tobytes()))
            held += len(packed) + len(words) + 4 * len(found)
            if held > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index as a table in the shared folder, a row per document with a term: row, doc_id, n,
    width, sketch (packed), terms, counts."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = read.mapInArrow(_index, "doc_id long, n long, width long, sketch binary, terms string, counts binary")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lexical")


# --- Queries ------------------------------------------------------------------------------------------

class Block:
    """The items of a query block: their different terms, weights, and numbers of occurrence."""

    def __init__(self, asked: pa.Table):
        """asked: item (a number), term, times, weight."""
        items = asked.column("item").to_numpy()
        self.items = np.unique(items)
        terms, self.term = np.unique(np.array(asked.column("term").to_pylist(), object), return_inverse=True)
        self.hashes = np.array([zlib.crc32(t.encode()) for t in terms], np.int64)
        order = np.argsort(items, kind="stable")
        self.term = self.term[order].astype(np.int64)
        self.item = np.searchsorted(self.items, items[order])
        self.weight = (asked.column("weight").to_numpy() * asked.column("times").to_numpy())[order]
        self.start = np.searchsorted(self.item, np.arange(len(self.items)))
        named = list(zip((str(t) for t in terms[self.term]), self.weight.tolist()))
        ends = np.append(self.start[1:], len(named))
        self.pairs = [named[a:b] for a, b in zip(self.start, ends)]  # (term, weight) of each item
        self._folded: dict[int, list] = {}

    def folded(self, width: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Weights by cell of a sketch of this width: (first item, cells, cells x items), in slices
        of bounded size."""
        if width not in self._folded:
            place = self.hashes[self.term] & (width - 1)
            slices, at = [], 0
            while at < len(self.items):
                end = at + 1
                while end < len(self.items):
                    pairs = np.searchsorted(self.item, end + 1) - self.start[at]
                    if min(pairs, width) * (end + 1 - at) > 1 << 22:
                        break
                    end += 1
                here = slice(self.start[at], np.searchsorted(self.item, end))
                cells, row = np.unique(place[here], return_inverse=True)
                weights = np.zeros((len(cells), end - at), np.float32)
                np.add.at(weights, (row, self.item[here] - at), self.weight[here].astype(np.float32))
                slices.append((at, cells, weights))
                at = end
            self._folded[width] = slices
        return self._folded[width]


def bounds(block: Block, batch: pa.RecordBatch, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(documents, items): upper bounds of the scores."""
    sketches, widths = batch.column("sketch"), batch.column("width").to_numpy()
    out = np.empty((len(sketches), len(block.items)), np.float32)
    known = _cell_counts()
    for width in np.unique(widths):
        docs = np.flatnonzero(widths == width)
        step = max(1, (1 << 22) // int(width))
        for at in range(0, len(docs), step):
            part = docs[at : at + step]
            cells = np.stack([
                np.frombuffer(pa.decompress(sketches[d].as_buffer(), decompressed_size=int(width), codec="zstd"), np.uint8)
                for d in part.tolist()
            ])
            for first, places, weights in block.folded(int(width)):
                found = cells[:, places]
                doc, cell = np.nonzero(found)
                top = np.minimum(known[found[doc, cell]], n[part][doc])
                impact = np.zeros(found.shape, np.float32)
                impact[doc, cell] = 1e9 * top / (1000 * top + 8 * m[part][doc])
                slack = 1 + EPS * (64 + len(places) + len(block.term))
                out[part, first : first + weights.shape[1]] = (impact @ weights) * np.float32(slack)
    return out


def counted(terms: str, counts: bytes) -> dict[str, int]:
    return dict(zip(terms.split(" "), np.frombuffer(counts, np.int32).tolist()))


def exact(pairs: list[tuple[str, int]], found: dict[str, int], m: int) -> int:
    """The score of one document for one item, in whole numbers."""
    score = 0
    for term, weight in pairs:
        count = found.get(term)
        if count:
            score += weight * (SCALE * count // (1000 * count + 8 * m))
    return score


def _best_bounds(shared, m_of, k: int):
    """The k highest bounds of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        top, rows = np.zeros((len(block.items), 0), np.float32), np.zeros((len(block.items), 0), np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            new = bounds(block, batch, n, m_of(n)).T
            top = np.concatenate((top, new), axis=1)
            rows = np.concatenate((rows, np.broadcast_to(batch.column("row").to_numpy(), new.shape)), axis=1)
            if top.shape[1] > k:
                keep = np.argpartition(-top, k - 1, axis=1)[:, :k]
                top, rows = np.take_along_axis(top, keep, 1), np.take_along_axis(rows, keep, 1)
        there = top > 0
        item = np.broadcast_to(block.items[:, None], top.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item[there]), pa.array(rows[there]), pa.array(top[there].astype(np.float64))], names=["item", "row", "bound"]
        )

    return run


def _score_given(shared, m_of):
    """Exact scores of the (row, items) chosen by their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        for batch in batches:
            items, scores = [], []
            sizes = m_of(batch.column("n").to_numpy()).tolist()
            for m, terms, counts, wanted in zip(sizes, *(batch.column(c).to_pylist() for c in ("terms", "counts", "items"))):
                found = counted(terms, counts)
                items += wanted
                scores += [exact(block.pairs[i], found, m) for i in np.searchsorted(block.items, wanted)]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(scores, pa.int64())], names=["item", "score"])

    return run


class Search:
    """Descending-bound scoring of one task's batches; ``scored`` of ``seen`` pairs of document
    and item were scored exactly."""

    def __init__(self, block: Block, threshold: np.ndarray, k: int):
        self.block, self.k, self.scored, self.seen = block, k, 0, 0
        self.least = np.maximum(threshold, 1)
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in block.items]  # (-score, id is null, id)

    def feed(self, batch: pa.RecordBatch, m_of) -> None:
        before = np.cumsum(pc.binary_length(batch.column("terms")).to_numpy(zero_copy_only=False)) // HELD
        cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            self._feed(batch.slice(start, end - start), m_of)

    def _feed(self, batch: pa.RecordBatch, m_of) -> None:
        n = batch.column("n").to_numpy()
        m = m_of(n)
        top = bounds(self.block, batch, n, m)
        self.seen += top.size
        ids, terms, counts = batch.column("doc_id").to_pylist(), batch.column("terms"), batch.column("counts")
        pending = top >= self.least
        known: dict[int, dict[str, int]] = {}  # terms of documents that were scored
        turn = 2 * self.k
        while True:
            item = np.flatnonzero(pending.any(axis=0))
            if not len(item):
                return
            # The next documents of each item, highest bounds first.
            left = np.where(pending[:, item], top[:, item], -1)
            take = min(turn, len(left))
            chosen = np.argpartition(-left, take - 1, axis=0)[:take] if take < len(left) else np.broadcast_to(np.arange(len(left))[:, None], left.shape)
            turn *= 2
            for i, docs in zip(item, chosen.T):
                docs = docs[pending[docs, i]]
                docs = docs[np.argsort(-top[docs, i], kind="stable")]
                for d, bound in zip(docs.tolist(), top[docs, i].tolist()):
                    if bound < self.least[i]:
                        break
                    if d not in known:
                        known[d] = counted(terms[d].as_py(), counts[d].as_py())
                    self.scored += 1
                    score = exact(self.block.pairs[i], known[d], int(m[d]))
                    if score >= self.least[i]:
                        self._offer(i, score, ids[d])
                pending[docs, i] = False
            pending &= top >= self.least

    def _offer(self, i: int, score: int, doc_id: int | None) -> None:
        best = self.best[i]
        best.append((-score, doc_id is None, doc_id or 0))
        best.sort()
        del best[self.k :]
        if len(best) == self.k:
            self.least[i] = max(self.least[i], -best[-1][0])

    def rows(self) -> pa.RecordBatch:
        found = [
            (int(i), None if missing else d, -s) for i, best in zip(self.block.items, self.best) for s, missing, d in best
        ]
        columns = list(zip(*found)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])


def _descend(shared, thresholds: dict[int, int], m_of, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        search = Search(block, np.array([thresholds.get(int(i), 0) for i in block.items], np.int64), k)
        for batch in batches:
            search.feed(batch, m_of)
        yield search.rows()

    return run


def _query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, block, term, times), one row per item and different term. ``item`` is a
    number of the row, ``block`` the query block it belongs to."""
    read = items.select(F.col(item_id).alias("doc_id"), F.col(text).alias("text"))
    numbered = materialize(read.withColumn("item", F.monotonically_increasing_id()), "items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, times = [], [], []
            for k, text in enumerate(row_bytes(batch.column(1))):
                found = Counter(terms_of(bytes(text)))
                rows += [k] * len(found)
                words += found.keys()
                times += found.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()),
            ], names=["item", "term", "times"])

    pairs = materialize(numbered.select("item", "text").mapInArrow(cut, "item long, term string, times long"), "pairs")
    sizes = pairs.groupBy("item").agg(F.greatest(F.count("*"), F.lit(256)).alias("size"))
    blocks = with_rank(sizes, [], ["item"], "before", "size").select(
        "item", F.expr(f"before div {BLOCK_PAIRS}").alias("block")
    )
    return pairs.join(blocks, "item").join(numbered.select("item", F.col("doc_id").alias("item_id")), "item")


def rank(index: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = index.sparkSession
    total = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    if not total.docs:
        return spark.createDataFrame([], schema)
    docs, terms = int(total.docs), int(total.terms)

    def m_of(n: np.ndarray) -> np.ndarray:
        return LOW + np.array([(75 * int(x) * docs) // terms for x in n], np.int64)

    held = index.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = _query_terms(items, item_id, text)
    weight = F.floor(F.lit(1000) * F.log((F.lit(2 * docs + 2) / (2 * F.col("df") + 1)).cast("double"))).cast("long")
    asked = materialize(asked.join(held, "term").withColumn("weight", weight), "asked")

    found = None
    for (number,) in asked.select("block").distinct().orderBy("block").collect():  # one row per block
        # A block: at most BLOCK_PAIRS pairs and one item more.
        here = asked.where(F.col("block") == number).select("item", "term", "times", "weight").toArrow()
        shared = spark.sparkContext.broadcast(here)
        best = index.select("row", "n", "width", "sketch").mapInArrow(_best_bounds(shared, m_of, k), "item long, row long, bound double")
        turn = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "row"))
        first = best.withColumn("turn", turn).where(F.col("turn") <= k).groupBy("row").agg(F.collect_list("item").alias("items"))
        scored = index.select("row", "n", "terms", "counts").join(first, "row").mapInArrow(_score_given(shared, m_of), "item long, score long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
        kth = scored.withColumn("place", place).where(F.col("place") == k).select("item", "score")
        thresholds = {r.item: r.score for r in kth.collect()}  # one row per item of the block
        rows = index.select("doc_id", "n", "width", "sketch", "terms", "counts").mapInArrow(
            _descend(shared, thresholds, m_of, k), "item long, doc_id long, score long"
        )
        found = rows if found is None else found.union(rows)
    if found is None:
        return spark.createDataFrame([], schema)
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    names = asked.select("item", "item_id").distinct()
    return found.withColumn("rank", order).where(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "doc_id", "score")


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
ORACLE = f"""
with d as (
  select row_number() over () as row, doc_id, {_TERMS} as t from documents where text is not null
), stats as (
  select count(*) as docs, cast(sum(len(t)) as bigint) as total from d where len(t) > 0
), q as (
  select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by 1, 2
), p as (
  select row, doc_id, n, term, count(*) as tf
  from (select row, doc_id, len(t) as n, unnest(t) as term from d) where term in (select term from q) group by 1, 2, 3, 4
), w as (
  select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from p, stats group by term, docs
), s as (
  select item_id, row, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) as bigint) as score
  from q join p using (term) join w using (term), stats group by item_id, row, doc_id
), r as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 10
"""


@query("op13_ranked_lexical_search", ORACLE)
def op13(spark, sf_dir):
    return rank(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
