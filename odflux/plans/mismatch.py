"""Demand and supply ranks of industries and how far they are apart.

Groups that are ranked hold one row per type. Supply scores are rounded before they are
ranked, so that equal scores tie although their sums differ in the last bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.operators.aggregates import share_of_group
from odflux.operators.filters import exclude_category
from odflux.operators.ranking import average_rank_desc, rank_mismatch

OTHER = "其他"  # Fixed value: the catch-all type.
SCORE = "flow_in_net_country_norm"


def demand_ranks(demand: DataFrame, group: str, other: str = OTHER) -> DataFrame:
    """Share and rank of each type per period and group; the catch-all goes first."""
    sums = demand.groupBy("time", group, "type").agg(F.sum("cnt").alias("cnt"))
    shares = exclude_category(share_of_group(sums, ["time", group]), "type", other)
    return average_rank_desc(shares, ["time", group], "ratio")


def supply_ranks(supply: DataFrame, group: str, other: str = OTHER, digits: int = 9) -> DataFrame:
    """Score and rank of each type per period and group; the catch-all takes a rank."""
    sums = supply.groupBy("time", group, "type").agg(F.round(F.sum(SCORE), digits).alias(SCORE))
    return exclude_category(average_rank_desc(sums, ["time", group], SCORE), "type", other)


def region_ranks(demand: DataFrame, supply: DataFrame, region_city: DataFrame, other: str = OTHER):
    """Demand and supply ranks per region."""
    side = lambda df: df.join(region_city, "name")
    return demand_ranks(side(demand), "region", other), supply_ranks(side(supply), "region", other)


def _rank_pairs(demand: DataFrame, supply: DataFrame, group: str) -> DataFrame:
    keys = ["time", group, "type"]
    return demand.select(*keys, F.col("rank").alias("rank_demand")).join(
        supply.select(*keys, F.col("rank").alias("rank_supply")), keys
    )


def city_mismatch(demand: DataFrame, supply: DataFrame, since: str, other: str = OTHER, mode: str = "industry", k: int = 10) -> DataFrame:
    """Mean rank distance per period and city: over all types, and over the types in
    the first ``k`` ranks of either side.

    One aggregate with conditions replaces three filtered copies and two outer joins.
    """
    late = lambda df: df.where(F.col("time") >= since)
    pairs = _rank_pairs(demand_ranks(late(demand), "name", other), supply_ranks(late(supply), "name", other), "name")
    scored = rank_mismatch(pairs)
    parts = ("mismatch", "demand_lack", "supply_lack")
    in_demand, in_supply = F.col("rank_demand") <= k, F.col("rank_supply") <= k
    return scored.groupBy("time", "name").agg(
        *[F.avg(c).alias(f"{mode}_{c}") for c in parts],
        *[F.avg(F.when(in_demand, F.col(c))).alias(f"{mode}_{c}_dtop{k}") for c in parts],
        *[F.avg(F.when(in_supply, F.col(c))).alias(f"{mode}_{c}_stop{k}") for c in parts],
    )


def region_mismatch(cities: DataFrame, region_city: DataFrame) -> DataFrame:
    """Mean of the cities' figures per period and region."""
    columns = [c for c in cities.columns if c not in ("time", "name")]
    return cities.join(region_city, "name").groupBy("time", "region").agg(*[F.avg(c).alias(c) for c in columns])


def mismatch_words(demand: DataFrame, supply: DataFrame, region_city: DataFrame, times=None, other: str = OTHER) -> DataFrame:
    """Types with weight and sign of the rank difference per region and period."""
    ranked = region_ranks(demand, supply, region_city, other)
    pairs = _rank_pairs(*ranked, "region")
    if times is not None:
        pairs = pairs.where(F.col("time").isin(list(times)))
    gap = F.col("rank_demand") - F.col("rank_supply")
    return pairs.select(
        "time", "region", "type", "rank_demand", "rank_supply", gap.alias("rank_diff"),
        F.abs(gap).alias("weight"), F.signum(gap).cast("int").alias("sign"),
    )
