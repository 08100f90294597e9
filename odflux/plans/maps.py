"""Tables behind the map pages: nodes and links, shaded places, comparisons, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.functions import scalars
from odflux.graph.degree import build_graph, edge_colors, region_subgraph, vertex_weights
from odflux.operators.aggregates import attach
from odflux.operators.filters import filter_by_edge_weight, filter_members
from odflux.operators.joins import compare_periods
from odflux.operators.projections import expand_alias

# Places left out of the cluster graph, the one without a comparison,
# and the metrics whose change is limited.
UNPLACED = ("三沙市", "台湾省")
UNCOMPARED = "山南市"
LIMITED_METRICS = ("flow_in_net", "flow_out_net", "average_salary_diff")
GREY = -1


def snapshot(edges: DataFrame, locations: DataFrame, time: str, normalize: bool = False) -> DataFrame:
    """Edges of one period between located places."""
    return build_graph(edges.where(F.col("time") == time), locations, normalize=normalize)


def _weights(vertices: DataFrame, scores: DataFrame, metric: str) -> DataFrame:
    if metric == "jd_All":
        # Known places show at least the floor; places without a score stay 0.
        scores = scores.withColumn(metric, scalars.floor_value(metric, scalars.DEMAND_FLOOR))
    return vertex_weights(vertices, scores, metric)


def nodes(
    edges: DataFrame, scores: DataFrame, locations: DataFrame, tiers: DataFrame, time: str, metric: str,
    threshold: float, size: float, logged: bool = True, region: DataFrame | None = None,
) -> DataFrame:
    """Places of the heavy edges with position, value, symbol size and tier class."""
    graph = snapshot(edges if region is None else region_subgraph(edges, region), locations, time)
    _, vertices = filter_by_edge_weight(graph, threshold, by=["time"])
    weighted = _weights(vertices, scores, metric)
    floored = F.greatest(F.col("weight").cast("double"), F.lit(0.0))
    if logged and metric in scalars.SIZE_BOUNDS:
        measure = scalars.bucket_by_bounds("weight", scalars.SIZE_BOUNDS[metric])
    else:
        measure = floored
    return (
        weighted.join(locations, "name").join(tiers.select("name", "tier"), "name", "left")
        .select(
            "name", F.round("ll_x", 2).alias("x"), F.round("ll_y", 2).alias("y"),
            F.round("weight", 4).alias("value"), (measure * F.lit(float(size))).cast("int").alias("symbol_size"),
            # Places without a tier take the last class.
            F.coalesce("tier", F.lit(5)).alias("tier_class"),
        )
    )


def links(
    edges: DataFrame, locations: DataFrame, tiers: DataFrame, time: str, threshold: float, region: DataFrame | None = None
) -> DataFrame:
    """Heavy edges with the positions of both ends and the source's tier."""
    graph = snapshot(edges if region is None else region_subgraph(edges, region), locations, time)
    heavy, _ = filter_by_edge_weight(graph, threshold)
    end = lambda side: locations.select(
        F.col("name").alias(side), F.round("ll_x", 2).alias(f"{side}_x"), F.round("ll_y", 2).alias(f"{side}_y")
    )
    tier = tiers.select(F.col("name").alias("src"), F.col("tier").alias("src_tier"))
    return (
        heavy.join(end("src"), "src").join(end("dst"), "dst").join(tier, "src", "left")
        .select("src", "dst", "src_x", "src_y", "dst_x", "dst_y", F.coalesce("src_tier", F.lit(5)).alias("src_tier"))
    )


def with_range(shaded: DataFrame, symmetric: bool, weight: str = "weight", wide_limit: float | None = None) -> DataFrame:
    """Attach the colour range; with negatives it may be made symmetric around 0."""
    low, high = F.col("_lo"), F.col("_hi")
    bounds = shaded.agg(F.min(weight).alias("_lo"), F.max(weight).alias("_hi"))
    reach = F.least(F.abs(low), F.abs(high))
    if wide_limit is not None:
        reach = F.when(high > 0, reach).otherwise(F.abs(low))
        if wide_limit > 0:
            reach = F.least(reach, F.lit(float(wide_limit)))
    mirrored = low < 0 if symmetric else F.lit(False)
    bounds = bounds.select(
        F.when(mirrored, -reach).otherwise(low).alias("min_w"), F.when(mirrored, reach).otherwise(high).alias("max_w")
    )
    return attach(shaded, bounds, [])


def _paint(weighted: DataFrame, aliases: DataFrame) -> DataFrame:
    return expand_alias(weighted, aliases).withColumn("value", F.round("weight", 4)).drop("weight")


def choropleth(
    edges: DataFrame, scores: DataFrame, locations: DataFrame, aliases: DataFrame, time: str, metric: str,
    threshold: float = 0, region: DataFrame | None = None,
) -> DataFrame:
    """Value per place of one period with the colour range of the page."""
    graph = snapshot(edges if region is None else region_subgraph(edges, region), locations, time)
    _, vertices = filter_by_edge_weight(graph, threshold, by=["time"])
    weighted = _weights(vertices, scores, metric).select("name", F.col("weight").cast("double").alias("weight"))
    # A region page shows the plain range.
    symmetric = "jd" not in metric and region is None
    return _paint(with_range(weighted, symmetric), aliases)


def typed_choropleth(edges, scores, locations, aliases, value: str, time: str, metric: str, threshold: float = 0) -> DataFrame:
    """The same for the edges and scores of one type value."""
    pick = lambda df: df.where(F.col("value") == value).drop("value")
    return choropleth(pick(edges), pick(scores), locations, aliases, time, metric, threshold)


def period_comparison(
    scores: DataFrame, metric: str, base: str, check: str, needed, threshold: float = 0.0005,
    trend: tuple[str, str] | None = None, sources: DataFrame | None = None,
) -> DataFrame:
    """Change of a metric per place between two periods.

    ``needed`` lists further periods a place must be present in. With ``trend`` (now,
    base) the change is scaled by the trend of that pair (estimate mode). With
    ``sources`` only listed places keep their change, others show 0.
    """
    times = list(dict.fromkeys([base, check, *needed, *(trend or ())]))
    wide = compare_periods(scores, "name", metric, times)
    total = wide.agg(F.sum(F.col(f"`{base}`")).alias("_total"))
    wide = attach(wide, total, [])
    at = lambda t: F.col(f"`{t}`")
    if trend is not None:
        change = scalars.seasonally_adjusted_change(at(check), at(base), at(trend[0]), at(trend[1]), threshold, "_total")
    elif metric == "average_salary_diff":
        change = scalars.guarded_salary_growth(at(check), at(base))
    else:
        change = scalars.guarded_growth(at(check), at(base), threshold, "_total")
    if metric in LIMITED_METRICS:
        change = scalars.clamp(change, -scalars.RATIO_LIMIT, scalars.RATIO_LIMIT)
    changed = wide.select("name", change.alias("change"))
    if sources is not None:
        kept = sources.select("name", F.lit(True).alias("_kept"))
        changed = changed.join(kept, "name", "left").withColumn(
            "change", F.when(F.col("_kept"), F.col("change")).otherwise(F.lit(0.0))
        ).drop("_kept")
    return changed.withColumn(
        "change", F.when(F.col("name") == UNCOMPARED, F.lit(0.0)).otherwise(F.col("change"))
    )


def comparison_map(changes: DataFrame, edges: DataFrame, locations: DataFrame, aliases: DataFrame, check: str, metric: str, threshold: float = 0) -> DataFrame:
    """Change per place of the checked period's graph, 0 where there is none."""
    _, vertices = filter_by_edge_weight(snapshot(edges, locations, check), threshold, by=["time"])
    rows = changes.select(F.lit(check).alias("time"), "name", "change")
    weighted = vertex_weights(vertices, rows, "change").select("name", "weight")
    limit = 3.0 if "jd" in metric else 0.0
    return _paint(with_range(weighted, True, wide_limit=limit), aliases)


def supported_sources(flows: DataFrame, time: str, minimum: float = 1000) -> DataFrame:
    """Source cities with more than a minimum count in the base period."""
    return flows.where((F.col("time") == time) & (F.col("cnt") > minimum)).select("name").distinct()


def cluster_places(edges, labels, locations, aliases, time: str, threshold: float = 0, normalize: bool = False) -> DataFrame:
    """Cluster of every place of a period, -1 where it has none."""
    graph = snapshot(edges, locations, time, normalize)
    _, vertices = filter_by_edge_weight(graph, threshold, filter_vertices=False, by=["time"])
    joined = vertices.join(labels.select("time", "name", F.col("label").alias("cluster")), ["time", "name"], "left")
    table = joined.select("name", F.coalesce("cluster", F.lit(GREY)).alias("cluster"))
    return expand_alias(table, aliases)


def cluster_nodes(edges, labels, locations, time: str, threshold: float, only_clustered: bool = False, unplaced=UNPLACED) -> DataFrame:
    """Places of the heavy edges with position and cluster."""
    graph = snapshot(edges, locations, time)
    _, vertices = filter_by_edge_weight(graph, threshold, filter_vertices=not only_clustered, by=["time"])
    joined = vertices.join(labels.select("time", "name", F.col("label").alias("cluster")), ["time", "name"], "left")
    table = joined.join(locations, "name").select(
        "name", F.round("ll_x", 2).alias("x"), F.round("ll_y", 2).alias("y"),
        F.coalesce("cluster", F.lit(GREY)).alias("cluster"),
    )
    if only_clustered:
        return table.where(F.col("cluster") != GREY)
    return filter_members(table, "name", unplaced, negate=True)


def cluster_links(edges, labels, locations, time: str, threshold: float, unplaced=UNPLACED) -> DataFrame:
    """Heavy edges with positions and the cluster both ends share, else -1."""
    heavy, _ = filter_by_edge_weight(snapshot(edges, locations, time), threshold)
    colored = edge_colors(heavy, labels, grey=unplaced)
    for side in ("src", "dst"):
        colored = filter_members(colored, side, unplaced, negate=True)
        ends = locations.select(
            F.col("name").alias(side), F.round("ll_x", 2).alias(f"{side}_x"), F.round("ll_y", 2).alias(f"{side}_y")
        )
        colored = colored.join(ends, side)
    return colored.select("src", "dst", "src_x", "src_y", "dst_x", "dst_y", "color")


def regional_mismatch_map(mismatch, edges, region: DataFrame, locations, aliases, time: str, metric: str, threshold: float = 0) -> DataFrame:
    """Mismatch of a region's places on the nationwide range of all periods."""
    _, vertices = filter_by_edge_weight(snapshot(region_subgraph(edges, region), locations, time), threshold, by=["time"])
    bounds = mismatch.agg(F.min(metric).alias("min_w"), F.max(metric).alias("max_w"))
    weighted = vertex_weights(vertices, mismatch, metric).select("name", "weight")
    return attach(_paint(weighted, aliases), bounds, [])


def topic_source_map(topic_places: DataFrame, topic: int, aliases: DataFrame) -> DataFrame:
    """Probabilities of one topic per place, four digits, capped."""
    capped = F.least(F.round("prob", 4), F.lit(scalars.TOPIC_WEIGHT_LIMIT))
    rows = topic_places.where(F.col("topic") == topic).select(F.col("word").alias("name"), capped.alias("value"))
    return expand_alias(rows, aliases)


def topic_list(topic_places: DataFrame) -> DataFrame:
    """Topics from 0 to the highest one seen."""
    top = topic_places.agg(F.max("topic").alias("m"))
    return top.where(F.col("m").isNotNull()).select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("topic"))


