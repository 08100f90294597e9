"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a target in words. Its documents are taken target / size times each: whole
times for certain, and the fraction by sampling. The sample is balanced: within a source, its
total of words and its number of documents stay what they are expected to be.

Flight phase: fractional inclusion probabilities move along a vector of the null space of the
two balancing constraints until one of them is 0 or 1, again and again; at most two documents
of a group stay fractional. Groups are slices of a source by a hash of the document, so a large
source is many groups. What stays fractional is grouped anew, level by level, until a source
has one group; its last one or two documents are the landing problem, settled by the sampling
design on them that keeps their probabilities and strays least from the totals.

Random choices come from hashes of the seed and the document, so reruns agree.

Defined results: a null or empty text has size zero; it still counts as a document. Null
sources form one source, last in the order of weights. A source of size zero has target zero
and is not taken. Repeated rows are separate documents of equal rank. Only (key, source, size)
is shuffled. Other columns pass through; ``size``, ``source_size``, ``target`` and ``taken`` are
added by the operator and replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.llm.common import count_words, materialize, table
from odflux.llm.registry import query

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5  # of all sizes, over all sources
MOST = 2.0  # times a source's size
GROUP = 4096  # documents of one flight
SEED = 5


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources in code point order, null last. A target stops at ``most``
    times its source's size. With t = target per weight of the sources not stopped, a source is
    stopped if size / weight is small; so after ranking by that ratio, the stopped sources are
    a prefix, and running sums give t for each possible prefix. No loop is needed.
    """
    # Strings compare by their UTF-8 bytes, which is the order of code points.
    position = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (position % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_weight", weight)
    ranked = ranked.withColumn("_ratio", most * F.col("source_size") / F.col("_weight"))
    by_ratio = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn(
        "_level",
        (share * F.sum("source_size").over(whole) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0)))
        / F.sum("_weight").over(rest),
    )
    # The first source whose cap is not reached sets the level for itself and all after it.
    ranked = ranked.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(whole))
    target = F.when(
        F.col("_level").isNull() | (F.col("_ratio") < F.col("_level")["_ratio"]), most * F.col("source_size")
    ).otherwise(F.least(F.col("_level")["_level"] * F.col("_weight"), most * F.col("source_size")))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def null_vector(columns: list[list[float]]) -> list[float]:
    """A non-zero vector orthogonal to each of the given vectors (fewer than their length), by
    elimination with partial pivots."""
    rows, n = [list(c) for c in columns], len(columns[0])
    pivots: list[int] = []
    for r in range(len(rows)):
        best, where = 1e-9, -1
        for c in range(n):
            if c not in pivots and abs(rows[r][c]) > best:
                best, where = abs(rows[r][c]), c
        if where < 0:
            pivots.append(-1)
            continue
        pivots.append(where)
        inverse = 1.0 / rows[r][where]
        rows[r] = [x * inverse for x in rows[r]]
        for q in range(len(rows)):
            if q != r and rows[q][where]:
                f = rows[q][where]
                rows[q] = [a - f * b for a, b in zip(rows[q], rows[r])]
    free = next(c for c in range(n) if c not in pivots)
    out = [0.0] * n
    out[free] = 1.0
    for r, p in enumerate(pivots):
        if p >= 0:
            out[p] = -rows[r][free]
    return out


def flight(probability: np.ndarray, totals: list[np.ndarray], draws: np.ndarray) -> np.ndarray:
    """Moves probabilities to 0 or 1 along null vectors of the totals; as many as there are
    totals may stay between."""
    p = probability.tolist()
    need = len(totals) + 1
    scaled = [(t / max(1.0, float(np.abs(t).max(initial=0)))).tolist() for t in totals]
    open_: list[int] = []
    follow = iter(range(len(p)))
    for step in range(len(p) + 1):
        while len(open_) < need:
            k = next(follow, None)
            if k is None:
                break
            if 1e-9 < p[k] < 1 - 1e-9:
                open_.append(k)
        if len(open_) < need:
            break
        u = null_vector([[t[k] for k in open_] for t in scaled])
        up = min((1 - p[k]) / x if x > 0 else -p[k] / x for k, x in zip(open_, u) if abs(x) > 1e-12)
        down = min(p[k] / x if x > 0 else (p[k] - 1) / x for k, x in zip(open_, u) if abs(x) > 1e-12)
        move = up if draws[step] * (up + down) < down else -down
        for k, x in zip(open_, u):
            p[k] += move * x
        for k in open_:
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        open_ = [k for k in open_ if 0 < p[k] < 1]
    return np.array(p)


def landing(p: list[float], sizes: list[float], draw: float) -> list[float]:
    """Settles the last one or two documents. With two, the designs that keep both
    probabilities differ in how often both are taken; the end with the smaller expected
    deviation from the two totals is used."""
    if len(p) == 1:
        return [1.0 if draw < p[0] else 0.0]
    a, b = p
    x, y = (s / max(1.0, *sizes) for s in sizes)

    def design(both: float) -> list[tuple[tuple[float, float], float]]:
        return [((1.0, 1.0), both), ((1.0, 0.0), a - both), ((0.0, 1.0), b - both), ((0.0, 0.0), 1 - a - b + both)]

    def cost(both: float) -> float:
        return sum(w * (((s - a) * x + (t - b) * y) ** 2 + (s + t - a - b) ** 2) for (s, t), w in design(both))

    chosen = design(min((max(0.0, a + b - 1), min(a, b)), key=cost))
    for result, w in chosen:
        if draw < w:
            return list(result)
        draw -= w
    return list(max(chosen, key=lambda c: c[1])[0])


def _draws(keys: np.ndarray, more: int) -> np.ndarray:
    """Numbers in [0, 1) that follow from the keys of the group and a running number."""
    seed = int(np.bitwise_xor.reduce(keys.view(np.uint64))) if len(keys) else 0
    return np.random.Generator(np.random.PCG64([seed, SEED, more])).random(len(keys) + 1)


def _settle(last: bool):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("key", "ascending"), ("size", "ascending"), ("p", "ascending")])
        keys = part.column("key").to_numpy()
        p, size = part.column("p").to_numpy(), part.column("size").to_numpy().astype(float)
        p = flight(p, [np.ones(len(p)), size], _draws(keys, part.num_rows))
        if last:
            left = np.flatnonzero((p > 0) & (p < 1))
            if len(left):
                p[left] = landing(p[left].tolist(), size[left].tolist(), float(_draws(keys[left], -1 % 97)[0]))
        return part.set_column(part.schema.get_field_index("p"), "p", pa.array(p))

    return run


def take(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size, source_size, target, taken) for every row: how many words the mix
    takes from it, a multiple of its size."""
    sized = materialize(
        docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), count_words(F.col(text)).alias("size")),
        "sized",
    )
    plan = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")).select(
        "source", "source_size"
    )), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "id", "a.source", "size", "source_size", "target", rate.alias("rate")
    )
    joined = joined.withColumns({
        "whole": F.floor(F.col("rate") + 1e-9), "key": F.xxhash64(F.lit(SEED), "id", "size"),
    }).withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    joined = materialize(joined.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p"))), "mix")
    done = joined.where("p = 0")
    open_, level = joined.where("p > 0"), 0
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema) + ", slice long"
    while True:
        counts = open_.groupBy("source").agg(F.ceil(F.count("*") / F.lit(float(GROUP))).alias("groups"))
        counts = materialize(counts, "groups")
        last = counts.where("groups > 1").isEmpty()
        cut = open_.alias("a").join(counts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
            *[F.col(f"a.{c}").alias(c) for c in joined.columns],
            F.pmod(F.xxhash64(F.lit(level), "key", "id"), F.col("groups")).alias("slice"),
        )
        moved = cut.groupBy("source", "slice").applyInArrow(_settle(last), kind).drop("slice")
        moved = materialize(moved, "flight")
        done = done.unionByName(moved.where("p = 0 or p = 1"))
        if last:
            break
        open_, level = moved.where("p > 0 and p < 1"), level + 1
    taken = ((F.col("whole") + F.col("p").cast("long")) * F.col("size")).cast("long")
    return done.select(
        F.col("id").alias(key), "source", "size", "source_size", "target", taken.alias("taken"),
        (F.col("whole") + F.col("p").cast("long")).cast("int").alias("copies"),
    )


@query("op5_mixing_sources")
def op5(spark, sf_dir):
    return take(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
