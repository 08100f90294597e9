"""Wage differences that flows overcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.functions import periods
from odflux.operators.filters import drop_self_edges, filter_quarter, min_support
from odflux.operators.joins import join_on_year_and_city, lookup_default
from odflux.plans.centrality import tier_name


def salary_difference(edges: DataFrame, wages: DataFrame, self_edges: bool = True, minimum: int = 100) -> DataFrame:
    """Flow-weighted wage difference per period, source city and type."""
    if not self_edges:
        edges = drop_self_edges(edges)
    edges = edges.withColumn("year", periods.period_year("time"))
    joined = join_on_year_and_city(edges, wages)
    grouped = joined.groupBy("time", F.col("src").alias("name"), "value").agg(
        F.sum(F.col("wage_diff") * F.col("cnt")).alias("salary_diff_weighted"), F.sum("cnt").alias("cnt")
    )
    enough = min_support(grouped, "cnt", minimum)
    return enough.withColumn("average_salary_diff", F.try_divide("salary_diff_weighted", "cnt"))


def salary_difference_by_tier(cities: DataFrame, tiers: DataFrame, quarter: int | None = None, scale: float = 1000.0) -> DataFrame:
    """The same per tier and type, re-aggregated from sums, in thousands."""
    known = lookup_default(cities, tiers, "name", "tier")
    if quarter is not None:
        known = filter_quarter(known, quarter)
    grouped = known.groupBy("value", "time", "tier").agg(
        F.sum("salary_diff_weighted").alias("salary_diff_weighted"), F.sum("cnt").alias("cnt")
    )
    return grouped.withColumns(
        {
            "average_salary_diff": F.try_divide("salary_diff_weighted", "cnt") / scale,
            "tier_name": tier_name(),
        }
    )
