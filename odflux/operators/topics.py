"""Topics of documents: k-means over sparse term weights, and soft topics on projected words.

Documents are rows (key, word, tf) as ``text.tf_vector`` gives them, with weights of one document
that sum to at most 1, next to a table with a row per document. Centres are a table: neither the
vocabulary nor a centre passes the driver, and neither has a limit.

K-means counts in whole steps of 2^-30, so distances are exact, topics do not depend on the order
of sums, and equal distances go to the smaller topic. The sum of one word's weights within a topic
must stay below 2^32; an overflow is raised beyond that.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from odflux.session import Rounds, materialize, placed, shuffles_dropped

STEPS = 1 << 30  # steps of a weight of 1
BITS = 52  # bits of a hash that a double holds
BLOCK = 32  # topics whose products share a row
WORDS = 1 << 18  # words in a block, about
PACK = 1 << 21  # weights of the documents that are packed together, about 16 MB
LEAST = 1 << 16  # weights worth a task
CHUNK = 1 << 11  # weights of short documents whose products are held at once
SUMS = 1 << 24  # bytes of the sums of all parts that meet in a group
SHORT = 64  # weights of a document in a block that are worth a call


def _hash(text) -> F.Column:
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


# ---- k-means -----------------------------------------------------------------

def _cuts(values) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _blobs(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) if v.is_valid else np.zeros(0, kind) for v in column]


def _table(kinds: dict, **columns) -> pa.Table:
    return pa.table({c: pa.array(columns[c], kind) for c, kind in kinds.items()})


def _number(rows: pa.Table) -> pa.Table:
    """The words of a block as one row of hashes, common words first."""
    h, n = rows["h"].to_numpy(), rows["n"].to_numpy()
    return _table({"block": pa.int32(), "hashes": pa.binary()}, block=[rows["block"][0].as_py()], hashes=[h[np.lexsort((h, -n))].tobytes()])


def _places(batches):
    for batch in batches:
        for block, blob in zip(batch["block"].to_pylist(), batch["hashes"].to_pylist()):
            h = np.frombuffer(blob, np.int64)
            yield pa.record_batch({"h": h, "block": np.full(len(h), block, np.int32), "place": np.arange(len(h), dtype=np.int32)})


def _runs(batches):
    """Neighbouring weights of one document as one row."""
    for batch in batches:
        first = _cuts(batch["key"].dictionary_encode().indices.to_numpy())
        ends = np.append(first[1:], batch.num_rows)
        h, x = batch["h"].to_numpy(), batch["x"].to_numpy()
        yield pa.record_batch({
            "key": batch["key"].take(pa.array(first)), "own": pa.array(np.zeros(len(first), bool)),
            "h": pa.array([h[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
            "x": pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
        })


def _mixed(h, x) -> np.ndarray:
    """A hash of word and weight."""
    z = h.view(np.uint64) ^ (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def _pack(labels: list[int], all_own: bool):
    """Of a part's runs and all words: a row with the documents, and a row of weights for each
    block of words, by document."""
    def pack(runs: pa.Table, words: pa.Table) -> pa.Table:
        if not runs.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("part", pa.int32()), ("block", pa.int32()), ("docs", pa.list_(runs.schema.field("key").type)), *((c, pa.binary()) for c in _PACKED))})
        part = labels[runs["p"][0].as_py()]
        coded = runs["key"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, keys = coded.indices.to_numpy(), coded.dictionary
        doc = np.repeat(code, pc.fill_null(pc.binary_length(runs["x"]), 0).to_numpy() // 4).astype(np.int32)
        own = np.full(len(keys), all_own)
        own[code[runs["own"].to_numpy(zero_copy_only=False)]] = True
        h, x = (np.concatenate(_blobs(runs[c], kind)) for c, kind in (("h", np.int64), ("x", np.int32)))
        if not own.all():
            mine, new = own[doc], (np.cumsum(own) - 1).astype(np.int32)
            h, x, doc, keys = h[mine], x[mine], new[doc[mine]], keys.filter(pa.array(own))
        words = words.sort_by("block")
        known = _blobs(words["hashes"], np.int64)
        at = pc.index_in(pa.array(h), value_set=pa.array(np.concatenate([np.zeros(0, np.int64), *known]))).to_numpy()
        xx, sig, out, start = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [], 0
        for block, size in zip(words["block"].to_pylist(), map(len, known)):
            here = np.flatnonzero((at >= start) & (at < start + size))
            here = here[np.argsort(doc[here].astype(np.int64) * size + (at[here] - start))]
            if len(here):
                first = _cuts(doc[here])
                mine, weight = doc[here][first], x[here]
                xx[mine] += np.add.reduceat(weight.astype(np.int64) ** 2, first)
                sig[mine] ^= np.bitwise_xor.reduceat(_mixed(h[here], weight), first)
                out.append({"part": part, "block": block, "doc": mine.tobytes(), "first": first.astype(np.int32).tobytes(),
                            "place": (at[here] - start).astype(np.int32).tobytes(), "x": weight.tobytes()})
            start += size
        kinds = {"part": pa.int32(), "block": pa.int32(), **{c: pa.binary() for c in _PACKED}}
        out = [{"part": part, "block": -1, "xx": xx.tobytes(), "sig": sig.tobytes()}, *out]
        packed = _table(kinds, **{c: [r.get(c) for r in out] for c in kinds})
        ends = pa.array([0, *[len(keys)] * len(out)], pa.int32())
        return packed.add_column(2, "docs", pa.ListArray.from_arrays(ends, keys))
    return pack


_PACKED = ("xx", "sig", "doc", "first", "place", "x")


class _Part:
    """The documents of a part, and their weights by block of words."""

    def __init__(self, rows: pa.Table):
        head = rows.filter(pc.equal(rows["block"], -1))
        self.docs = head["docs"].combine_chunks().flatten()
        self.xx, self.sig = (np.concatenate([np.zeros(0, np.int64), *_blobs(head[c], np.int64)]) for c in ("xx", "sig"))
        rest = rows.filter(pc.greater_equal(rows["block"], 0))
        kinds = (("doc", np.int32), ("first", np.int32), ("place", np.int32), ("x", np.int32))
        self.blocks = dict(zip(rest["block"].to_pylist(), zip(*(_blobs(rest[c], kind) for c, kind in kinds))))

    def dots(self, centres: pa.Table, topics: int) -> tuple[np.ndarray, np.ndarray]:
        """Products of documents and centres, and the squares of centres, in whole numbers."""
        out, squares = np.zeros((len(self.docs), topics), np.int64), np.zeros(topics, np.int64)
        slabs: dict = {}
        for block, start, width, blob in zip(*(centres[c].to_pylist() for c in ("block", "start", "width")), centres["w"]):
            slab = np.frombuffer(blob.as_buffer(), f"i{width}").reshape(-1, topics)
            squares += np.einsum("ij,ij->j", slab, slab, dtype=np.int64, casting="safe")
            slabs.setdefault(block, []).append((start, slab))
        for block in slabs.keys() & self.blocks.keys():
            doc, first, place, x = self.blocks[block]
            size = max([int(place.max()) + 1, *(start + len(slab) for start, slab in slabs[block])])
            w = np.zeros((size, topics), np.result_type(*(slab for _, slab in slabs[block])))
            for start, slab in slabs.pop(block):
                w[start : start + len(slab)] = slab
            ends = np.append(first, len(x))
            long = np.diff(ends) >= SHORT
            for i in np.flatnonzero(long).tolist():
                a, b = ends[i], ends[i + 1]
                out[doc[i]] += np.dot(x[a:b].astype(np.int64), w.take(place[a:b], axis=0))
            if long.all():
                continue
            rest = np.repeat(~long, np.diff(ends))
            doc, place, x, first = doc[~long], place[rest], x[rest], np.cumsum(np.append(0, np.diff(ends)[~long]))
            cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(x), CHUNK)), len(doc)))
            for i, j in zip(cuts[:-1], cuts[1:]):
                a, b = first[i], first[j]
                products = w.take(place[a:b], axis=0).astype(np.int64)
                products *= x[a:b, None]
                out[doc[i:j]] += np.add.reduceat(products, first[i:j] - a, axis=0)
        return out, squares

    def nearest(self, centres: pa.Table, topics: int) -> tuple[np.ndarray, np.ndarray]:
        """The smallest (score, topic) of each document, where the score is the squared distance
        less the document's own square: the centre's square less twice the product."""
        out, squares = self.dots(centres, topics)
        score = squares - 2 * out
        if centres.num_rows:
            score[:, np.frombuffer(centres["n"][0].as_buffer(), np.int64) == 0] = np.iinfo(np.int64).max
        best = score.argmin(axis=1)  # the first of equals
        return score[np.arange(len(best)), best], best

    def sums(self, topic: np.ndarray, topics: int, blocks: int, starts: range) -> pa.Table:
        """Documents by topic, and their weights by word and topic, from each start in every block
        of words."""
        n, out = np.bincount(topic, minlength=topics).tobytes(), []
        for block in range(blocks):
            total = np.zeros(0, np.int64)
            if block in self.blocks:
                doc, first, place, x = self.blocks[block]
                at = place * np.int64(topics) + np.repeat(topic[doc], np.diff(first, append=len(x)))
                total = np.zeros((int(place.max()) + 1) * topics, np.int64)
                for a in range(0, len(x), 1 << 22):  # doubles are exact below 2^53
                    total += np.bincount(at[a : a + (1 << 22)], x[a : a + (1 << 22)], len(total)).astype(np.int64)
            out += [(block, a, total[a * topics : (a + starts.step) * topics].tobytes()) for a in starts]
        block, start, s = zip(*out)
        return _table(_SUMS, block=block, start=start, n=[n] * len(out), s=s, before=[None] * len(out))


_SUMS = {"block": pa.int32(), "start": pa.int32(), "n": pa.binary(), "s": pa.binary(), "before": pa.binary()}
_CENTRES = {"block": pa.int32(), "start": pa.int32(), "width": pa.int32(), "n": pa.binary(), "w": pa.binary()}


def _means(topics: int):
    """Of the sums of all parts from one start in a block of words: the centres there."""
    def means(rows: pa.Table) -> pa.Table:
        n, total = np.zeros(topics, np.int64), np.zeros(0, np.int64)
        for part, s in zip(_blobs(rows["n"], np.int64), _blobs(rows["s"], np.int64)):
            if len(part):
                n += part
            if len(s) > len(total):
                total = np.concatenate([total, np.zeros(len(s) - len(total), np.int64)])
            total[: len(s)] += s
            if len(total) and int(total.max()) >> 62:
                raise OverflowError("the sum of a word's weights in a topic is above 2^32")
        w = (total.reshape(-1, topics) // np.maximum(n, 1)).astype(np.int32)
        old = [b.as_py() for b in rows["before"] if b.is_valid]
        return _table({**_CENTRES, "moved": pa.bool_()}, block=[rows["block"][0].as_py()], start=[rows["start"][0].as_py()], width=[4], n=[n.tobytes()], w=[w.tobytes()],
                      moved=[old != [n.tobytes() + w.tobytes()]])
    return means


def _dense(topics: int):
    """Rows (block, place, topic, w) of a block as its centres."""
    def dense(rows: pa.Table) -> pa.Table:
        place, topic, value = (rows[c].to_numpy() for c in ("place", "topic", "w"))
        width = 4 if int(np.abs(value).max()) <= STEPS else 8
        w = np.zeros((int(place.max()) + 1, topics), f"i{width}")
        np.add.at(w, (place, topic), value.astype(w.dtype))
        return _table(_CENTRES, block=[rows["block"][0].as_py()], start=[0], width=[width], n=[np.ones(topics, np.int64).tobytes()], w=[w.tobytes()])
    return dense


class _Packs:
    """Weights packed by part and block of words, to be met by many centres.

    A part has the documents of about PACK weights, whole. Words are told apart by a hash that no
    two of them share, and fall in blocks of about WORDS. Parts lie in a bucket each and never
    move; centres, four bytes a word and topic, are sent to each part. A part's products, its
    documents' topics and the sums that move the centres come from one task, which holds its
    weights, the centres, and the products of one block of words and CHUNK weights.
    """

    def __init__(self, x: DataFrame, key: str, docs: DataFrame | None = None):
        spark, self.key, self.kind = x.sparkSession, key, x.schema[key].dataType.simpleString()
        for self.seed in itertools.count(1):
            seen = Observation()
            kinds = x.groupBy(self._hash(), "word").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
            kinds = materialize(kinds.observe(
                seen, F.count("*").alias("words"), F.sum("n").alias("weights"), F.count_if(F.col("kinds") > 1).alias("clashes")), "words")
            if not seen.get["clashes"]:
                break
        words, weights = seen.get["words"], seen.get["weights"] or 0
        self.blocks = max(1, math.ceil(words / WORDS))
        least = min(spark.sparkContext.defaultParallelism, math.ceil(weights / LEAST))
        n = max(1, math.ceil(weights / PACK), least)
        self.labels = _labels(spark, n)
        block = F.expr(f"cast(pmod(h, {self.blocks}L) as int)").alias("block")
        self.size = kinds.groupBy(block).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        self.words = kinds.select("h", "n", block).groupBy("block").applyInArrow(_number, "block int, hashes binary")
        rows = x.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), self._hash(), F.col("x").cast("int"))
        kind = f"key {self.kind}, own boolean, h binary, x binary"
        rows = rows.mapInArrow(_runs, kind)
        if docs is not None:
            none = F.lit(None).cast("binary")
            rows = rows.unionByName(docs.select(F.col(key).alias("key"), F.lit(True).alias("own"), none.alias("h"), none.alias("x")))
        rows = rows.withColumn("p", F.expr(f"cast(pmod(xxhash64(key), {n}L) as int)"))
        each = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p")
        both = rows.groupBy("p").cogroup(self.words.select(each, "block", "hashes").groupBy("p"))
        kind = f"part int, block int, docs array<{self.kind}>, " + ", ".join(f"{c} binary" for c in _PACKED)
        self.rows = placed(both.applyInArrow(_pack(self.labels, docs is None), kind), "part", n, "packs")

    def _hash(self) -> F.Column:
        return F.xxhash64("word", F.lit(self.seed)).alias("h")

    def _meet(self, centres: DataFrame, kind: str, build) -> DataFrame:
        """What ``build`` makes of each part and all centres."""
        everywhere = centres.select(F.explode(F.array(*map(F.lit, self.labels))).alias("part"), *_CENTRES)
        both = self.rows.groupBy("part").cogroup(everywhere.groupBy("part"))
        return both.applyInArrow(lambda rows, found: build(_Part(rows), found), kind)

    def dots(self, centres: DataFrame) -> DataFrame:
        """(key, block, _0, ...): sums over common words with the centres (topic, word, w), for
        each block of topics."""
        topics = (centres.agg(F.max("topic")).first()[0] or 0) + 1
        places = self.words.mapInArrow(_places, "h long, block int, place int")
        dense = centres.select(self._hash(), "topic", "w").join(places, "h")
        key = self.key

        def build(part: _Part, found: pa.Table) -> pa.Table:
            out, _ = part.dots(found, topics)
            out = np.pad(out, ((0, 0), (0, -topics % BLOCK)))
            return pa.concat_tables(pa.table({
                key: part.docs, "block": pa.array(np.full(len(out), j // BLOCK, np.int32)),
                **{f"_{i}": out[:, j + i] for i in range(BLOCK)},
            }) for j in range(0, topics, BLOCK))

        kind = f"`{self.key}` {self.kind}, block int, " + ", ".join(f"_{i} long" for i in range(BLOCK))
        return self._meet(dense.groupBy("block").applyInArrow(_dense(topics), _ddl(_CENTRES)), kind, build)

    def drawn(self, keys: list) -> DataFrame:
        """Centres at the documents with these keys, in their order."""
        def pick(rows: pa.Table) -> pa.Table:
            part, out = _Part(rows), []
            found = pc.index_in(part.docs, value_set=pa.array(keys, part.docs.type)).to_numpy(zero_copy_only=False)
            topic = np.where(np.isnan(found), -1, found).astype(np.int32)
            for block, (doc, first, place, x) in part.blocks.items():
                mine = np.repeat(topic[doc], np.diff(first, append=len(x)))
                at = np.flatnonzero(mine >= 0)
                out.append(_table(kinds, block=np.full(len(at), block), place=place[at], topic=mine[at], w=x[at]))
            return pa.concat_tables([_table(kinds, **dict.fromkeys(kinds, [])), *out])

        kinds = {"block": pa.int32(), "place": pa.int32(), "topic": pa.int32(), "w": pa.int64()}
        rows = self.rows.groupBy("part").applyInArrow(pick, "block int, place int, topic int, w long")
        return rows.groupBy("block").applyInArrow(_dense(len(keys)), _ddl(_CENTRES))

    def nearest(self, centres: DataFrame, topics: int) -> DataFrame:
        """(key, xx, sig, best): each document's square, a hash of its weights, and the smallest
        (score, topic), null without centres."""
        key = self.key

        def build(part: _Part, found: pa.Table) -> pa.Table:
            s, topic = part.nearest(found, topics) if topics else (pa.nulls(len(part.docs), pa.int64()), pa.nulls(len(part.docs), pa.int32()))
            return pa.table({key: part.docs, "xx": part.xx, "sig": part.sig, "s": s, "topic": pa.array(topic, pa.int32())})

        rows = self._meet(centres, f"`{self.key}` {self.kind}, xx long, sig long, s long, topic int", build)
        best = F.when(F.col("topic").isNotNull(), F.struct("s", "topic")).alias("best")
        return rows.select(self.key, "xx", "sig", best)

    def means(self, centres: DataFrame, topics: int, before: DataFrame | None) -> DataFrame:
        """The means of the documents nearest to each centre, and whether they differ from those
        of ``before``, by block of words and start in it."""
        blocks, starts = self.blocks, range(0, max(1, self.size), max(1, SUMS // (8 * topics * len(self.labels))))
        sums = self._meet(centres, _ddl(_SUMS), lambda part, found: part.sums(part.nearest(found, topics)[1], topics, blocks, starts))
        if before is not None:
            none = F.lit(None).cast("binary")
            sums = sums.unionByName(before.select("block", "start", none.alias("n"), none.alias("s"), F.concat("n", "w").alias("before")))
        return sums.groupBy("block", "start").applyInArrow(_means(topics), _ddl(_CENTRES) + ", moved boolean")


def _ddl(kinds: dict) -> str:
    return ", ".join(f"{c} {'int' if t == pa.int32() else 'binary'}" for c, t in kinds.items())


def _labels(spark, n: int) -> list[int]:
    """A number for each of ``n`` buckets that falls in it."""
    bucket = F.expr(f"pmod(hash(id), {n})").alias("bucket")
    rows = spark.range(50 * n).select(F.col("id").cast("int").alias("id")).groupBy(bucket).agg(F.min("id").alias("id"))
    labels = [r["id"] for r in rows.orderBy("bucket").collect()]
    assert len(labels) == n
    return labels


def _draw(state: DataFrame, n: int, have: int, key: str, seed: int) -> DataFrame:
    """``n`` documents with odds by squared distance to their nearest centre, as topics ``have``,
    ``have + 1``, ...: the smallest exponential variates whose rates are the distances.

    Equal documents are drawn as one, with their joint odds. The window orders ``n`` rows.
    """
    far = F.when(F.col("best").isNull(), F.lit(1)).otherwise(F.col("xx") + F.col("best.s"))
    chance = (_hash(F.concat_ws(":", key, F.lit(seed), F.lit(have))) + 1).cast("double") / float(1 << BITS)
    kinds = (
        state.withColumn("_d2", far).where("_d2 > 0")
        .groupBy("sig").agg(F.min(F.struct((-F.log(chance) / F.col("_d2")).alias("o"), key, "xx")).alias("_first"))
    )
    took = kinds.select("_first.*").orderBy("o", key).limit(n)
    number = F.row_number().over(Window.orderBy("o", key)) - 1 + have
    return took.select(number.alias("topic"), key, F.col("xx").alias("nn"))


def kmeans_topics(
    docs: DataFrame, weights: DataFrame, key: str, k: int = 30, seed: int = 1, max_iter: int = 20
) -> DataFrame:
    """(key, topic) for every row of ``docs``, which has unique keys; topics are 0 to k - 1.

    First centres are documents drawn in rounds that double their number, each with odds by the
    squared distance to the centres before. Then documents go to the nearest centre and centres to
    the mean of their documents, until no centre moves or ``max_iter`` rounds are over. Documents
    without a weight take part as zeros. Fewer different documents than ``k`` give as many topics;
    a topic that loses all documents is gone. No documents give no rows.

    Weights are packed once, whole documents of a part in a bucket. A round is one job: each part
    finds its documents' topics and sums their weights by topic and word, sums meet by block of
    words, and the new centres, which alone are written, are sent to each part. The driver holds
    the ``k`` drawn keys. A round's shuffles are dropped when it is written.
    """
    spark = docs.sparkSession
    whole = F.floor(F.col("tf") * STEPS).cast("long")
    with shuffles_dropped(spark):
        packs = _Packs(weights.select(key, "word", whole.alias("x")).where("x > 0"), key, docs.select(key))
        store, drawn = Rounds(spark, "topics"), []
        centres = spark.createDataFrame([], _ddl(_CENTRES))
        while len(drawn) < k:
            state = packs.nearest(centres, len(drawn))
            took = _draw(state, min(max(len(drawn), 1), k - len(drawn)), len(drawn), key, seed).collect()
            if not took:
                break
            drawn += [r[key] for r in sorted(took, key=lambda r: r["topic"])]
            centres = store.keep(packs.drawn(drawn))
        before = None
        for _ in range(max_iter if drawn else 0):
            seen = Observation()
            after = packs.means(centres, len(drawn), before)
            centres = before = store.keep(after.observe(seen, F.count_if("moved").alias("moved")))
            if seen.get["moved"] == 0:
                break
        found = packs.nearest(centres, len(drawn)).select(key, F.col("best.topic").alias("topic"))
        return materialize(found, "topics")


# ---- soft topics -------------------------------------------------------------

def project(docs: DataFrame, weights: DataFrame, key: str, dims: int, seed: int = 1, out: str = "reduced") -> DataFrame:
    """``docs`` with an array of ``dims`` numbers per document: the sum of its weights, each with a
    sign drawn per word and dimension by a hash, over the root of ``dims``.

    Distances are kept in expectation, whatever the vocabulary, and nothing is fitted. Documents
    without a weight get zeros.
    """
    drawn = [_hash(F.concat_ws(":", "word", F.lit(seed), F.lit(i))) for i in range(math.ceil(dims / BITS))]
    signed = weights.select(key, "tf", F.array(*drawn).alias("_h"))
    bit = lambda j: F.shiftright(F.col("_h")[j // BITS], j % BITS).bitwiseAND(F.lit(1))
    sums = [F.sum(F.when(bit(j) == 1, F.col("tf")).otherwise(-F.col("tf"))) for j in range(dims)]
    root = math.sqrt(dims)
    reduced = signed.groupBy(key).agg(*[(s / root).alias(f"_p{j}") for j, s in enumerate(sums)])
    parts = F.array(*[F.coalesce(f"_p{j}", F.lit(0.0)) for j in range(dims)])
    return docs.join(reduced, key, "left").withColumn(out, parts).drop(*[f"_p{j}" for j in range(dims)])


def soft_topics(
    docs: DataFrame, weights: DataFrame, key: str, k: int, dims: int = 8, seed: int = 1, max_iter: int = 20
) -> DataFrame:
    """``docs`` with the array ``probability`` of its memberships in ``k`` topics, which sum to 1:
    a mixture of normal distributions over projected weights. A step of the mixture passes sums of
    k times the square of ``dims`` numbers."""
    points = project(docs, weights, key, dims, seed).withColumn("reduced", array_to_vector("reduced"))
    points = materialize(points, "projected")
    model = GaussianMixture(
        k=k, seed=seed, maxIter=max_iter, featuresCol="reduced", predictionCol="topic", probabilityCol="_p"
    ).fit(points)
    return model.transform(points).withColumn("probability", vector_to_array("_p")).drop("_p", "reduced")
