"""Job demand by tier, region and category. Demand tables are wide (``jd_<category>``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.operators.aggregates import attach, count_sum_rate, ratio_of_sums, share_of_group
from odflux.operators.filters import filter_period
from odflux.operators.joins import left_join_fill, lookup_default
from odflux.operators.stats import macro_metrics

# Categories of the trend report and of the occupation report.
TREND_CATEGORIES = (
    "Blue Collar", "White Collar", "Transporter", "Engineer",
    "Designer", "Public Transit Staff", "Factory Worker", "Manager",
)
REGION_CATEGORIES = ("Blue Collar", "White Collar", "Transporter", "Factory Worker")
OCCUPATIONS = ("Transporter", "Factory Worker", "Public Transit Staff")
BASE = "Blue Collar"
COUNTRY = -1  # Stands for the whole country in the tier column.


def _columns(categories):
    return [f"jd_{c}" for c in categories]


def _present_always(df: DataFrame, key: str) -> DataFrame:
    """Rows of keys that occur in every period of the table."""
    periods = df.agg(F.count_distinct("time").alias("_periods"))
    counts = df.groupBy(key).agg(F.count_distinct("time").alias("_n"))
    always = attach(counts, periods, []).where(F.col("_n") == F.col("_periods")).select(key)
    return df.join(always, key, "left_semi")


def _long(df: DataFrame, ids, columns, value: str) -> DataFrame:
    long = df.unpivot(list(ids), list(columns), "category", value)
    return long.withColumn("category", F.expr("substring(category, 4)"))


def demand_trend(scores: DataFrame, demand: DataFrame, tiers: DataFrame, until: str, categories=TREND_CATEGORIES) -> DataFrame:
    """Demand in thousands per tier, period and category.

    Cities of the centrality table without demand count as 0; only cities present in
    every period enter.
    """
    columns = _columns(categories)
    joined = left_join_fill(scores.select("name", "time"), demand.select("name", "time", *columns), ["name", "time"])
    known = lookup_default(_present_always(filter_period(joined, high=until), "name"), tiers, "name", "tier")
    sums = known.groupBy("tier", "time").agg(*[(F.sum(f"`{c}`") / 1000).alias(c) for c in columns])
    return _long(sums, ["tier", "time"], columns, "thousands")


def tier_share(demand: DataFrame, tiers: DataFrame, categories=(BASE,)) -> DataFrame:
    """Share of each tier in a category's total of the period (cities with a tier)."""
    columns = _columns(categories)
    known = lookup_default(demand.select("name", "time", *columns), tiers, "name", "tier")
    sums = known.groupBy("tier", "time").agg(*[F.sum(f"`{c}`").alias(c) for c in columns])
    long = _long(sums, ["tier", "time"], columns, "cnt")
    return share_of_group(long, ["time", "category"], "cnt", "occupation").select("tier", "time", "category", "occupation")


def occupation_shares(demand: DataFrame, tiers: DataFrame, occupations=OCCUPATIONS, base: str = BASE) -> DataFrame:
    """Occupations over the base category, per tier and for the whole country (tier -1)."""
    columns = _columns(occupations)
    rows = demand.select("name", "time", *columns, f"jd_{base}")
    tiered = ratio_of_sums(lookup_default(rows, tiers, "name", "tier"), ["tier", "time"], columns, f"jd_{base}")
    country = ratio_of_sums(rows, ["time"], columns, f"jd_{base}").withColumn("tier", F.lit(COUNTRY))
    return _long(tiered.unionByName(country), ["tier", "time"], columns, "occupation")


def growth_statistics(
    demand: DataFrame, tiers: DataFrame, base: str, now: str, later: str, early: tuple[str, str],
    category: str = BASE, part: str = "Public Transit Staff",
) -> DataFrame:
    """Named growth figures, for the country (tier -1) and per tier.

    One conditional aggregate gives all sums; ``early`` is the pair (first, second) of
    the recovery after the base period.
    """
    known = demand.join(tiers.select("name", "tier"), "name", "left")
    pick = lambda c, t: F.sum(F.when(F.col("time") == t, F.col(f"`jd_{c}`")))
    sums = [
        pick(category, base).alias("base"), pick(category, now).alias("now"), pick(category, later).alias("later"),
        pick(part, base).alias("part_base"), pick(part, later).alias("part_later"),
        pick(category, early[0]).alias("first"), pick(category, early[1]).alias("second"),
    ]
    used = known.where(F.col("time").isin(base, now, later, *early))
    country = used.agg(*sums).withColumn("tier", F.lit(COUNTRY))
    tiered = used.where(F.col("tier").isNotNull()).groupBy("tier").agg(*sums)
    figures = {
        "growth": F.try_divide("now", "base") - 1,
        "later_ratio": F.try_divide("later", "base"),
        "part_later_ratio": F.try_divide("part_later", "base"),
        "part_share": F.try_divide("part_base", "base"),
        "recovery": F.try_divide("second", "first") - 1,
    }
    table = country.unionByName(tiered).select("tier", *[f.alias(n) for n, f in figures.items()])
    return table.unpivot(["tier"], list(figures), "statistic", "value")


def topic_precision(annotations: DataFrame, exclude: str = "Others") -> DataFrame:
    return count_sum_rate(annotations, "name", "label", exclude)


def topic_quality(annotations: DataFrame, truth: str = "label", predicted: str = "name") -> DataFrame:
    return macro_metrics(annotations, truth, predicted)


def _by_region(scores: DataFrame, demand: DataFrame, region_city: DataFrame, columns) -> DataFrame:
    joined = left_join_fill(scores.select("name", "time"), demand.select("name", "time", *columns), ["name", "time"])
    return (
        joined.join(region_city, "name")
        .groupBy("region", "time").agg(*[F.sum(f"`{c}`").alias(c) for c in columns])
    )


def region_trend(scores: DataFrame, demand: DataFrame, region_city: DataFrame, until: str, categories=REGION_CATEGORIES) -> DataFrame:
    """Demand in thousands per region, period and category."""
    columns = _columns(categories)
    sums = filter_period(_by_region(scores, demand, region_city, columns), high=until)
    long = _long(_present_always(sums, "region"), ["region", "time"], columns, "thousands")
    return long.withColumn("thousands", F.col("thousands") / 1000)


def region_occupations(
    scores: DataFrame, demand: DataFrame, region_city: DataFrame, until: str, occupations=OCCUPATIONS, base: str = BASE
) -> DataFrame:
    """Occupations over the base category per region and period."""
    columns = _columns(occupations)
    sums = filter_period(_by_region(scores, demand, region_city, [*columns, f"jd_{base}"]), high=until)
    return _long(ratio_of_sums(sums, ["region", "time"], columns, f"jd_{base}"), ["region", "time"], columns, "occupation")
