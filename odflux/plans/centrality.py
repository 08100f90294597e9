"""How centrality differs between tiers, changes over time and goes with output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.functions import periods as P
from odflux.functions import scalars
from odflux.graph.degree import aggregate_by_group
from odflux.operators.aggregates import attach, present_in_all_periods, share_of_group
from odflux.operators.filters import filter_members
from odflux.operators.joins import compare_periods, lookup_default, lookup_strict
from odflux.operators.ranking import five_number_summary, median
from odflux.operators.sorting import top_k
from odflux.operators.stats import correlations

# Tiers by number.
TIER_NAMES = ("Tier 1", "New tier 1", "Tier 2", "Tier 3", "Tier 4", "Tier 5")
TOP_TIERS = (0, 1)
CORRELATED = ("pr", "flow_in", "flow_out", "flow_in_net", "hub", "authority")


def tier_name(tier: str = "tier"):
    return F.get(F.array(*[F.lit(n) for n in TIER_NAMES]), F.col(tier))


def tier_trend(scores: DataFrame, tiers: DataFrame) -> DataFrame:
    """Summed authority and hub, mean gross flow and net inflow per period and tier."""
    known = lookup_default(scores, tiers, "name", "tier")
    return known.groupBy("time", "tier").agg(
        F.sum("authority").alias("authority"), F.sum("hub").alias("hub"),
        F.avg("gross_flow").alias("gross_flow"),
        F.avg("flow_in_net_country_norm").alias("flow_in_net_country_norm"),
    ).withColumns({"tier_name": tier_name(), "top": F.col("tier").isin(list(TOP_TIERS))})


def tier_boxes(scores: DataFrame, tiers: DataFrame, metric: str, times) -> DataFrame:
    """Box-plot figures of a metric per period and tier."""
    chosen = lookup_default(filter_members(scores, "time", times), tiers, "name", "tier")
    return five_number_summary(chosen, ["time", "tier"], metric)


def city_lines(scores: DataFrame, names, translation: DataFrame) -> DataFrame:
    """Authority and hub of named cities over time."""
    chosen = lookup_strict(filter_members(scores, "name", names), translation, "name", "en_name")
    return chosen.select(
        F.col("en_name").alias("city"), "time", P.period_to_date("time").alias("period"), "authority", "hub"
    )


def change_by_tier(scores: DataFrame, tiers: DataFrame, metric: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Relative change of each city between named periods, long form with its tier.

    ``pairs`` maps a label to (now, base); only cities present in all periods count.
    """
    times = sorted({t for pair in pairs.values() for t in pair})
    wide = lookup_default(compare_periods(scores, "name", metric, times), tiers, "name", "tier")
    changes = wide.select(
        "name", "tier", *[scalars.growth(F.col(f"`{now}`"), F.col(f"`{base}`")).alias(k) for k, (now, base) in pairs.items()]
    )
    return changes.unpivot(["name", "tier"], list(pairs), "metric", "increase")


def second_order_change(scores: DataFrame, metric: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Change of one change relative to another, per city."""
    wide = compare_periods(scores, "name", metric, sorted({*first, *second}))
    one, two = (scalars.growth(F.col(f"`{a}`"), F.col(f"`{b}`")) for a, b in (first, second))
    changes = wide.select("name", one.alias("first"), two.alias("second"))
    return changes.withColumn("change", scalars.growth("first", "second"))


def tier_flow_change(edges: DataFrame, tiers: DataFrame, pairs) -> DataFrame:
    """Change of tier-to-tier flow shares between periods, one matrix per pair.

    Rows are source tiers in order, columns target tiers.
    """
    between = aggregate_by_group(filter_members(edges, "time", sorted({t for p in pairs for t in p})), tiers, "tier")
    shares = share_of_group(between, ["time", "src"], "cnt", "share").select("time", "src", "dst", "share")
    rows = None
    for now, base in pairs:
        side = lambda t, c: shares.where(F.col("time") == t).select("src", "dst", F.col("share").alias(c))
        change = side(now, "now").join(side(base, "base"), ["src", "dst"]).select(
            F.lit(f"{now}/{base}").alias("periods"), F.col("src").alias("tier"), "dst",
            (F.try_divide("now", "base") - 1).alias("increase"),
        )
        rows = change if rows is None else rows.unionByName(change)
    matrix = rows.groupBy("periods", "tier").pivot("dst", list(range(len(TIER_NAMES)))).agg(F.max("increase"))
    return matrix.withColumnsRenamed({str(i): f"to_{i}" for i in range(len(TIER_NAMES))}).orderBy("periods", "tier")


def gdp_correlation(scores: DataFrame, gdp: DataFrame, times, method: str = "pearson", k: int | None = None, columns=CORRELATED) -> DataFrame:
    """Correlation of centralities with output over cities known in every period; a report on
    the k cities of largest output names k."""
    joined = scores.join(gdp.select("name", "gdp"), "name")
    names = present_in_all_periods(joined, times)
    rows = joined.join(names, "name", "left_semi").where(F.col("time") == list(times)[-1])
    if k is not None:
        rows = top_k(rows.where(F.col("gdp") != -1), "gdp", k, ("name",))
    return correlations(rows, list(columns), "gdp", method)


def hub_authority_classes(scores: DataFrame, tiers: DataFrame) -> DataFrame:
    """Hub/authority ratio and the quadrant by the medians of the period and tier."""
    known = lookup_default(scores, tiers, "name", "tier").select("time", "name", "tier", "hub", "authority")
    keys = ["time", "tier"]
    lines = median(known, keys, "authority", "authority_median").join(median(known, keys, "hub", "hub_median"), keys)
    high = lambda c: (F.col(c) >= F.col(f"{c}_median")).cast("int")
    return (
        attach(known, lines, keys)
        .withColumn("ratio", scalars.smoothed_ratio("hub", "authority"))
        .withColumn("quadrant", 2 * high("authority") + high("hub"))
    )
