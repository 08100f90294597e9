"""PageRank and HITS for all snapshots in one loop.

Each round joins the edges with a table of one row per vertex and sums by target with
map-side partial sums, so a vertex's in-edges are not gathered in one task. Edges are written
once in buckets by the vertex they are joined on (HITS: a copy for each end), where the sums of
a round already lie, so a round moves partial sums and no edges. The out-edges of one vertex are
one bucket's; their number is at most that of the vertices of its snapshot.
The vertex table of a round is written to the shared folder: the next plan is short,
survives lost executors, and knows the table's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.graph.degree import normalize_out
from odflux.operators.filters import vertices_of
from odflux.session import Rounds, bucketed, materialize


class NotConverged(RuntimeError):
    """A loop reached its limit of rounds before its stopping rule held."""


def _inflow(links: DataFrame, state: DataFrame, by, damping: float) -> DataFrame:
    """What each edge hands from its source to its target."""
    return links.join(state.withColumnRenamed("name", "src"), [*by, "src"]).select(
        *by, F.col("dst").alias("name"), (damping * F.col("pr") * F.col("w")).alias("pr")
    )


def _across(links: DataFrame, scores: DataFrame, by, start: str, end: str, score: str, out: str) -> DataFrame:
    """Weighted sums at one end of the edges of the scores at their other end."""
    given = scores.select(*by, F.col("name").alias(start), score)
    return (
        links.join(given, [*by, start])
        .groupBy(*by, F.col(end).alias("name")).agg(F.sum(F.col(score) * F.col("w")).alias(out))
    )


def pagerank(
    edges: DataFrame, rounds: int | None = None, damping: float = 0.85, tol: float = 1e-6,
    max_rounds: int = 100, inverse: bool = False, step: int = 6, by=("time",),
) -> DataFrame:
    """Weighted PageRank per snapshot, columns keys, ``name``, ``pr``.

    Weights are normalised by the source's out-flow, so raw and row-normalised edges
    give the same result. The mass of vertices without out-edges is spread evenly: it is
    one sum per snapshot, added to what every vertex gets. The summed change of a snapshot
    is checked every ``step`` rounds against ``tol`` times its vertex count, and
    ``NotConverged`` is raised after ``max_rounds``; with ``rounds`` a fixed number of
    rounds runs instead.
    """
    by = list(by)
    if inverse:
        edges = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "cnt")
    spark = edges.sparkSession
    summed = edges.groupBy(*by, "src", "dst").agg(F.sum("cnt").alias("cnt"))
    links = bucketed(normalize_out(summed, by).withColumnRenamed("cnt", "w"), [*by, "src"], "links")
    names = vertices_of(links, by)
    sizes = names.groupBy(*by).agg(F.count("*").alias("n"))
    sources = links.select(*by, "src").distinct().select(*by, F.col("src").alias("name"), F.lit(True).alias("_has"))
    nodes = materialize(
        names.join(sizes, by).join(sources, [*by, "name"], "left")
        .select(*by, "name", "n", F.col("_has").isNull().alias("dangling")), "nodes",
    )
    spread = not nodes.where("dangling").isEmpty()
    base = nodes.select(*by, "name", ((1.0 - damping) / F.col("n")).alias("pr"))
    if spread:
        step = 1  # each round reads the last one twice, so each is written

    def advance(state):
        given = base
        if spread:
            lost = state.join(nodes.where("dangling"), [*by, "name"]).groupBy(*by).agg(F.sum("pr").alias("_lost"))
            given = nodes.join(lost, by, "left").select(
                *by, "name", ((1.0 - damping + damping * F.coalesce("_lost", F.lit(0.0))) / F.col("n")).alias("pr")
            )
        return _inflow(links, state, by, damping).unionByName(given).groupBy(*by, "name").agg(F.sum("pr").alias("pr"))

    store = Rounds(spark, "pagerank")
    state = nodes.select(*by, "name", (1.0 / F.col("n")).alias("pr"))
    left = max_rounds if rounds is None else rounds
    while left > 0:
        now = min(step, left)
        for _ in range(now - (rounds is None)):
            state = advance(state)
        state = store.keep(state)
        left -= now
        if rounds is None:
            before, state = state, store.keep(advance(state))
            change = (
                state.join(before.withColumnRenamed("pr", "old"), [*by, "name"]).join(sizes, by)
                .groupBy(*by).agg(F.sum(F.abs(F.col("pr") - F.col("old"))).alias("d"), F.max("n").alias("n"))
            )
            worst = change.agg(F.max(F.col("d") / F.col("n"))).first()[0]
            if worst is None or worst < tol:
                return state
    if rounds is None:
        raise NotConverged(f"change {worst} per vertex after {max_rounds} rounds")
    return state


def hits(
    edges: DataFrame, rounds: int | None = None, tol: float = 1e-8, max_rounds: int = 1000,
    normalize: bool = False, step: int = 6, by=("time",),
) -> DataFrame:
    """Hubs and authorities per snapshot, each scaled to sum 1.

    A round sets authority = in-sum of hub and hub = out-sum of authority. Weights are
    divided by the snapshot's total, which keeps several unscaled rounds in range, so
    ``step`` rounds form one plan between two scalings. ``NotConverged`` is raised if the
    stopping rule does not hold after ``max_rounds``.
    """
    by = list(by)
    spark = edges.sparkSession
    summed = edges.groupBy(*by, "src", "dst").agg(F.sum("cnt").alias("cnt"))
    if normalize:
        summed = normalize_out(summed, by)
    totals = summed.groupBy(*by).agg(F.sum("cnt").alias("_total"))
    weighted = summed.join(totals, by).select(*by, "src", "dst", F.try_divide("cnt", "_total").alias("w"))
    by_src = bucketed(weighted, [*by, "src"], "links")
    by_dst = bucketed(by_src, [*by, "dst"], "links")
    nodes = materialize(vertices_of(by_src, by), "nodes")
    store = Rounds(spark, "hits")

    def authority(hub):
        return _across(by_src, hub, by, "src", "dst", "hub", "authority")

    def hubs(auth):
        return _across(by_dst, auth, by, "dst", "src", "authority", "hub")

    def scaled(table, column):
        sums = table.groupBy(*by).agg(F.sum(column).alias("_sum"))
        return table.join(sums, by).withColumn(column, F.try_divide(F.col(column), F.col("_sum"))).drop("_sum")

    hub = nodes.withColumn("hub", F.lit(1.0))
    left = max_rounds if rounds is None else rounds
    while left > 0:
        now = min(step, left)
        before = hub
        for _ in range(now):
            hub = hubs(authority(hub))
        hub = scaled(store.keep(hub), "hub")
        left -= now
        if rounds is None:
            old = scaled(before, "hub").withColumnRenamed("hub", "old")
            gap = F.abs(F.coalesce("hub", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
            change = hub.join(old, [*by, "name"], "full_outer").groupBy(*by).agg(F.sum(gap).alias("d"))
            worst = change.agg(F.max("d")).first()[0]
            if worst is None or worst < tol:
                break
    else:
        if rounds is None:
            raise NotConverged(f"change {worst} after {max_rounds} rounds")
    auth = scaled(materialize(authority(hub), "authority"), "authority")
    return (
        nodes.join(hub, [*by, "name"], "left").join(auth, [*by, "name"], "left")
        .na.fill(0.0, ["hub", "authority"]).select(*by, "name", "hub", "authority")
    )
