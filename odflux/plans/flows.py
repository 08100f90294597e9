"""From trips to daily flows and to the tables of every grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.functions import periods
from odflux.graph.degree import net_inflow_per_mille
from odflux.operators.aggregates import multi_grain_rollup
from odflux.sources.files import clean_edges


def months_between(daily: DataFrame, start, end) -> DataFrame:
    """Days of a range of months; comparing dates keeps the filter usable by the scan."""
    first = F.make_date(F.lit(start[0]), F.lit(start[1]), F.lit(1))
    last = F.last_day(F.make_date(F.lit(end[0]), F.lit(end[1]), F.lit(1)))
    return daily.where((F.col("event_date") >= first) & (F.col("event_date") <= last))


def read_graph(daily: DataFrame, grain: str, coarse: str, start, end, self_edge: bool = False) -> DataFrame:
    """Edges of one grain and place level for a range of months."""
    edges = (
        months_between(daily, start, end)
        .groupBy(
            periods.period_label("event_date", grain).alias("time"),
            F.col(f"{coarse}_from").alias("src"), F.col(f"{coarse}_to").alias("dst"),
        )
        .agg(F.sum("cnt").alias("cnt"))
    )
    return clean_edges(edges, self_edge)


def grain_tables(daily: DataFrame, start, end, self_edge: bool = False) -> DataFrame:
    """All six tables (grain, coarse, time, src, dst, cnt) for a range of months."""
    return clean_edges(multi_grain_rollup(months_between(daily, start, end)), self_edge)


def net_inflow_by_quarter(edges: DataFrame) -> DataFrame:
    """Net inflow per mille by quarter and city, from edges with self edges."""
    return net_inflow_per_mille(clean_edges(edges, self_edge=True))
