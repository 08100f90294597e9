"""Graph construction, degrees and flows. Edges: keys, ``src``, ``dst``, ``cnt``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.operators.aggregates import share_of_group
from odflux.operators.filters import filter_members

BY = ("time",)


def build_graph(edges: DataFrame, locations: DataFrame, places=None, normalize: bool = False, by=BY) -> DataFrame:
    """Edges between located (or listed) places, optionally over the source's out-flow."""
    # An end of an edge is a vertex anyway, so located ends are the located vertices.
    if places is None:
        places = locations.select("name")
    kept = filter_members(filter_members(edges, "src", places), "dst", places)
    if not normalize:
        return kept
    shares = share_of_group(kept, [*by, "src"], "cnt", "_share")
    return shares.withColumn("cnt", F.col("_share")).drop("_share")


def normalize_out(edges: DataFrame, by=BY) -> DataFrame:
    """Weights over the out-flow of their source."""
    return share_of_group(edges, [*by, "src"], "cnt", "_share").withColumn("cnt", F.col("_share")).drop("_share")


def end_flows(edges: DataFrame, by=BY) -> DataFrame:
    """Weighted in- and out-flow per vertex: both ends in one aggregate, no outer join."""
    zero = F.lit(0).cast(edges.schema["cnt"].dataType)
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("name"), zero.alias("flow_in"), F.col("cnt").alias("flow_out")),
            F.struct(F.col("dst").alias("name"), F.col("cnt").alias("flow_in"), zero.alias("flow_out")),
        )
    )
    return (
        edges.select(*by, ends.alias("e")).select(*by, "e.*")
        .groupBy(*by, "name")
        .agg(F.sum("flow_in").alias("flow_in"), F.sum("flow_out").alias("flow_out"))
    )


def degrees(edges: DataFrame, vertices: DataFrame | None = None, by=BY) -> DataFrame:
    """In, out and net flow per place; listed places without edges get 0."""
    flows = end_flows(edges, by)
    if vertices is not None:
        flows = vertices.select(*by, "name").distinct().join(flows, [*by, "name"], "left").na.fill(0)
    return flows.withColumns(
        {
            "flow_in_net": F.col("flow_in") - F.col("flow_out"),
            "flow_out_net": F.col("flow_out") - F.col("flow_in"),
        }
    )


def gross_flow(edges: DataFrame, by=BY) -> DataFrame:
    """Share of a place's outflow that leaves it; self edges must be included."""
    leaving = F.sum(F.when(F.col("src") != F.col("dst"), F.col("cnt")).otherwise(F.lit(0)))
    return edges.groupBy(*by, F.col("src").alias("name")).agg(
        F.try_divide(leaving, F.sum("cnt")).alias("gross_flow")
    )


def net_inflow_per_mille(edges: DataFrame, by=BY) -> DataFrame:
    """(in - out) * 1000 over all flow of the period, self edges included."""
    flows = end_flows(edges, by)
    # Every edge arrives once, so all flow is the sum over the far smaller in-flows.
    totals = flows.groupBy(*by).agg(F.sum("flow_in").alias("_total"))
    net = (F.col("flow_in") - F.col("flow_out")) * F.lit(1000.0)
    return (
        flows.join(totals, list(by))
        .select(*by, "name", F.try_divide(net, F.col("_total")).alias("flow_in_net_country_norm"))
    )


def undirected_edges(edges: DataFrame, by=BY) -> DataFrame:
    """Both directions summed, one row per pair with ``src < dst``."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .groupBy(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.sum("cnt").alias("cnt"))
    )


def aggregate_by_group(edges: DataFrame, groups: DataFrame, group: str, by=BY) -> DataFrame:
    """Edges between groups of places; places outside any group are left out."""
    side = lambda end: groups.select(F.col("name").alias(end), F.col(group).alias(f"_{end}"))
    # Sums per pair first, so that the joins see one row per pair and period.
    return (
        edges.groupBy(*by, "src", "dst").agg(F.sum("cnt").alias("cnt"))
        .join(side("src"), "src").join(side("dst"), "dst")
        .groupBy(*by, F.col("_src").alias("src"), F.col("_dst").alias("dst"))
        .agg(F.sum("cnt").alias("cnt"))
    )


def region_subgraph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members."""
    return filter_members(filter_members(edges, "src", members), "dst", members)


def edge_colors(edges: DataFrame, labels: DataFrame, label: str = "label", grey=(), by=BY) -> DataFrame:
    """Edge takes the cluster both ends share, else -1; listed places force -1."""
    side = lambda end: labels.select(*by, F.col("name").alias(end), F.col(label).alias(f"_{end}"))
    shared = F.coalesce(F.when(F.col("_src") == F.col("_dst"), F.col("_src")), F.lit(-1))
    if grey:
        listed = F.col("src").isin(list(grey)) | F.col("dst").isin(list(grey))
        shared = F.when(listed, F.lit(-1)).otherwise(shared)
    return (
        edges.join(side("src"), [*by, "src"], "left").join(side("dst"), [*by, "dst"], "left")
        .withColumn("color", shared).drop("_src", "_dst")
    )


def vertex_weights(vertices: DataFrame, table: DataFrame, metric: str, by=BY) -> DataFrame:
    """Metric of each vertex, 0 where the table lacks it."""
    values = table.select(*by, "name", F.col(metric).alias("weight"))
    return vertices.join(values, [*by, "name"], "left").na.fill(0, ["weight"])
