"""Centrality tables put together from the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.graph.degree import build_graph, degrees, gross_flow, net_inflow_per_mille, normalize_out
from odflux.graph.rank import hits, pagerank
from odflux.operators.aggregates import per_mille_norm
from odflux.operators.filters import drop_self_edges, vertices_of
from odflux.session import materialize


def rank_columns(edges: DataFrame, rounds: int | None = None, hits_rounds: int | None = None, by=("time",)) -> DataFrame:
    """PageRank both ways and HITS raw and normalised, in two loops.

    Direction, or normalisation, is one more key of the snapshot. Raw and normalised
    PageRank coincide, so each is published under both names.
    """
    by = list(by)
    edges = edges.groupBy(*by, "src", "dst").agg(F.sum("cnt").alias("cnt"))
    turned = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "cnt")
    both = edges.withColumn("way", F.lit("out")).unionByName(turned.withColumn("way", F.lit("in")))
    pr = pagerank(both, rounds=rounds, by=[*by, "way"])
    pick = lambda way, col: F.max(F.when(F.col("way") == way, F.col(col)))
    pr = pr.groupBy(*by, "name").agg(
        pick("out", "pr").alias("pr"), pick("out", "pr").alias("pr_norm"),
        pick("in", "pr").alias("pr_norm_inv"), pick("in", "pr").alias("pr_inv"),
    )
    raw = edges.select(*by, "src", "dst", F.col("cnt").cast("double").alias("cnt"))
    kinds = raw.withColumn("way", F.lit("raw")).unionByName(normalize_out(raw, by).withColumn("way", F.lit("norm")))
    scores = hits(kinds, rounds=hits_rounds, by=[*by, "way"])
    scores = scores.groupBy(*by, "name").agg(
        pick("raw", "hub").alias("hub"), pick("raw", "authority").alias("authority"),
        pick("norm", "hub").alias("hub_norm"), pick("norm", "authority").alias("authority_norm"),
    )
    return pr.join(scores, [*by, "name"], "full_outer").na.fill(0.0)


def centrality_table(
    edges: DataFrame, locations: DataFrame, rounds: int | None = None, hits_rounds: int | None = None,
    pr_hits: bool = True, by=("time",),
) -> DataFrame:
    """All measures per (keys, name); ``edges`` include self edges.

    Degrees, PageRank and HITS use edges between different, located places; gross flow
    and net inflow use all edges. A measure a place lacks is 0.
    """
    by = list(by)
    edges = materialize(edges.groupBy(*by, "src", "dst").agg(F.sum("cnt").alias("cnt")), "edges")
    between = drop_self_edges(edges)
    graph = build_graph(between, locations, by=by)
    # A located place whose partners are not located stays, with zero flow.
    kept = vertices_of(between, by).join(locations.select("name"), "name", "left_semi")
    table = degrees(graph, kept, by)
    if pr_hits:
        table = table.join(rank_columns(graph, rounds, hits_rounds, by), [*by, "name"], "left")
    # Gross flow exists for sources, net inflow for every place, as an inner join.
    flows = gross_flow(edges, by).join(net_inflow_per_mille(edges, by), [*by, "name"])
    return table.join(flows, [*by, "name"], "full_outer").na.fill(0)


def typed_centrality_table(
    edges: DataFrame, demand: DataFrame, locations: DataFrame, rounds: int | None = None,
    hits_rounds: int | None = None, pr_hits: bool = True,
) -> DataFrame:
    """Centrality per type value with demand counts and per-mille columns.

    ``edges`` (time, value, src, dst, cnt) include self edges; the type is one more key
    of every aggregate, so all types are computed together.
    """
    by = ["time", "value"]
    edges = materialize(edges.groupBy(*by, "src", "dst").agg(F.sum("cnt").alias("cnt")), "typed")
    between = drop_self_edges(edges)
    graph = build_graph(between, locations, by=by)
    kept = vertices_of(between, by).join(locations.select("name"), "name", "left_semi")
    table = degrees(graph, kept, by)
    if pr_hits:
        table = table.join(rank_columns(graph, rounds, hits_rounds, by), [*by, "name"], "left")
    table = table.join(gross_flow(edges, by), [*by, "name"], "full_outer").na.fill(0)
    whole = build_graph(edges, locations, by=by)
    with_self = degrees(whole, by=by).select(
        *by, "name", F.col("flow_in").alias("all_flow_in"), F.col("flow_out").alias("all_flow_out")
    )
    table = table.join(with_self, [*by, "name"], "full_outer").na.fill(0)
    jobs = demand.groupBy("time", "name", F.col("type").alias("value")).agg(F.sum("cnt").alias("jdcount"))
    table = materialize(table.join(jobs, ["time", "name", "value"]), "typed_table")
    columns = ["flow_in", "flow_out", "all_flow_in", "all_flow_out", "jdcount"]
    return per_mille_norm(per_mille_norm(table, columns, "country"), columns, "name").na.fill(0)
