"""Shortest-path centralities by level-wise expansion from batches of sources.

Both measures need every (source, vertex) pair that is connected. A batch of sources is expanded
at a time, for all snapshots together; its sums by vertex are kept and its pairs deleted, so what
is stored at once is bounded by the batch and not by the square of the places. Edge weights are
not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.operators.filters import vertices_of
from odflux.session import materialize, released, scratch_path

PAIRS = 1 << 30  # pairs of a batch, at most, beside those of one source


def _sources(nodes: DataFrame, by, pairs: int):
    """Number of batches, and vertices with their ``batch``: by a hash, about as many pairs each."""
    sizes = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    all_pairs = sizes.agg(F.sum(F.col("n").cast("decimal(38,0)") * F.col("n"))).first()[0] or 0
    count = max(1, -(-int(all_pairs) // pairs))
    batch = F.pmod(F.xxhash64(*by, "name"), F.lit(count))
    return count, nodes.select(*by, "name", batch.alias("batch"))


def _levels(links: DataFrame, sources: DataFrame, by):
    """Breadth-first levels: tables (keys, s, v, d, sigma) with path counts."""
    start = sources.select(
        *by, F.col("name").alias("s"), F.col("name").alias("v"),
        F.lit(0).alias("d"), F.lit(1.0).alias("sigma"),
    )
    levels = [materialize(start, "level")]
    seen = levels[0].select(*by, "s", "v")
    while True:
        step = (
            levels[-1].select(*by, "s", F.col("v").alias("src"), "sigma")
            .join(links, [*by, "src"])
            .groupBy(*by, "s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
            .join(seen, [*by, "s", "v"], "left_anti")
            .select(*by, "s", "v", F.lit(len(levels)).alias("d"), "sigma")
        )
        step = materialize(step, "level")
        if step.isEmpty():
            return levels
        levels.append(step)
        seen = seen.unionByName(step.select(*by, "s", "v"))


def _union(parts):
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part)
    return found


def _sums(edges: DataFrame, by, pairs: int, of_batch):
    """Vertices, and the sums that ``of_batch(links, levels)`` gives, batch by batch."""
    spark = edges.sparkSession
    links = materialize(
        edges.where(F.col("src") != F.col("dst")).select(*by, "src", "dst").distinct(), "links"
    )
    nodes = materialize(vertices_of(edges, by), "vertices")
    count, sources = _sources(nodes, by, pairs)
    kept = []
    for batch in range(count):
        target = scratch_path(spark, "sums")
        with released(spark):
            levels = _levels(links, sources.where(F.col("batch") == batch), by)
            kept.append(materialize(of_batch(links, levels), path=target))
    return nodes, _union(kept)


def _distances(by):
    def of_batch(links, levels):
        return _union(
            level.groupBy(*by, F.col("v").alias("name")).agg(
                F.count("*").alias("reached"), F.sum("d").alias("distance")
            ) for level in levels
        ).groupBy(*by, "name").agg(F.sum("reached").alias("reached"), F.sum("distance").alias("distance"))

    return of_batch


def _dependencies(by):
    def of_batch(links, levels):
        through, delta = [levels[0].select(*by, F.col("v").alias("name"), F.lit(0.0).alias("value"))], None
        for depth in range(len(levels) - 1, 0, -1):
            here = levels[depth]
            if delta is not None:
                here = here.join(delta, [*by, "s", "v"], "left")
            else:
                here = here.withColumn("delta", F.lit(0.0))
            # What each vertex of this level passes back to its predecessors, per path.
            back = here.select(
                *by, "s", F.col("v").alias("dst"),
                ((1.0 + F.coalesce("delta", F.lit(0.0))) / F.col("sigma")).alias("unit"),
            )
            upper = levels[depth - 1].select(*by, "s", F.col("v").alias("src"), "sigma")
            delta = materialize(
                upper.join(links, [*by, "src"]).join(back, [*by, "s", "dst"])
                .groupBy(*by, "s", F.col("src").alias("v"))
                .agg(F.sum(F.col("sigma") * F.col("unit")).alias("delta")),
                "delta",
            )
            through.append(delta.where(F.col("s") != F.col("v")).select(*by, F.col("v").alias("name"), F.col("delta").alias("value")))
        return _union(through).groupBy(*by, "name").agg(F.sum("value").alias("value"))

    return of_batch


def closeness(edges: DataFrame, by=("time",), pairs: int = PAIRS) -> DataFrame:
    """Closeness on incoming distances, scaled by the reachable share. No edges give no rows."""
    by = list(by)
    nodes, sums = _sums(edges, by, pairs, _distances(by))
    sizes = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    total = sums.groupBy(*by, "name").agg(
        F.sum("reached").alias("reached"), F.sum("distance").alias("distance")
    )
    others = (F.col("reached") - 1).cast("double")
    value = F.try_divide(others, F.col("distance")) * F.try_divide(others, F.col("n") - 1)
    return total.join(sizes, by).select(*by, "name", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def betweenness(edges: DataFrame, normalized: bool = True, by=("time",), pairs: int = PAIRS) -> DataFrame:
    """Share of shortest paths through each vertex (directed, end points excluded). No edges give
    no rows."""
    by = list(by)
    nodes, sums = _sums(edges, by, pairs, _dependencies(by))
    sizes = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    total = sums.groupBy(*by, "name").agg(F.sum("value").alias("value"))
    value = F.coalesce("value", F.lit(0.0))
    if normalized:
        value = F.when(F.col("n") > 2, value / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(value)
    return nodes.join(sizes, by).join(total, [*by, "name"], "left").select(*by, "name", value.alias("betweenness"))
