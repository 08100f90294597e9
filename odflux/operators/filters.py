"""Row filters and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.functions import periods, scalars
from odflux.sources.files import SENTINEL


def filter_any_keyword(df: DataFrame, column: str, words) -> DataFrame:
    return df.where(scalars.contains_any(column, words))


def safe_parse(log: DataFrame) -> DataFrame:
    """Typed log columns; rows whose time or point does not parse are dropped."""
    parsed = log.select(
        "query", "title", "userid",
        periods.parse_compact_timestamp("stamp").alias("event_time"),
        scalars.point_part("location", 1).alias("x"),
        scalars.point_part("location", 2).alias("y"),
    )
    return parsed.na.drop(subset=["event_time", "x", "y"])


def drop_nulls(df: DataFrame, columns) -> DataFrame:
    return df.na.drop(subset=list(columns))


def drop_sentinel(df: DataFrame, columns, sentinel: str = SENTINEL) -> DataFrame:
    for column in columns:
        df = df.where(F.col(column) != sentinel)
    return df


def drop_self_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.where(F.col(src) != F.col(dst))


def filter_members(df: DataFrame, column: str, members, negate: bool = False) -> DataFrame:
    """Rows whose value is (not) in a list, or in the column of the same name of a table."""
    if isinstance(members, DataFrame):
        keys = members.select(F.col(members.columns[0]).alias(column)).where(F.col(column).isNotNull())
        return df.join(keys, column, "left_anti" if negate else "left_semi")
    test = F.col(column).isin(list(members))
    return df.where(~test if negate else test)


def filter_period(df: DataFrame, low: str | None = None, high: str | None = None, column: str = "time") -> DataFrame:
    if low is not None:
        df = df.where(F.col(column) >= low)
    if high is not None:
        df = df.where(F.col(column) <= high)
    return df


def drop_boundary_periods(df: DataFrame, start, end, grain: str, column: str = "time") -> DataFrame:
    """Keep the periods of the requested months; what leaks in from the files goes."""
    low, high = periods.period_bounds(start, end, grain)
    return filter_period(df, low, high, column)


def filter_quarter(df: DataFrame, quarter: int | str, column: str = "time") -> DataFrame:
    return df.where(F.try_element_at(F.split(column, "Q"), F.lit(2)) == str(quarter))


def exclude_category(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) != value)


def vertices_of(edges: DataFrame, by=()) -> DataFrame:
    """Distinct endpoints of the edges, per key."""
    ends = edges.select(*by, F.explode(F.array("src", "dst")).alias("name"))
    return ends.distinct()


def filter_by_edge_weight(edges: DataFrame, threshold: float, filter_vertices: bool = True, by=()):
    """Edges heavier than a threshold, and the vertices of those or of all edges."""
    heavy = edges.where(F.col("cnt") > threshold)
    return heavy, vertices_of(heavy if filter_vertices else edges, by)


def min_support(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Groups whose count or size is strictly above a minimum."""
    return df.where(F.col(column) > minimum)


def _hash32(keys, seed: int):
    """First 32 bits of an MD5 over the keys and a seed, the same in any engine; null counts as
    empty, so keys keep their places."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def sample_fraction(df: DataFrame, fraction: float, keys=None, seed: int = 42) -> DataFrame:
    """Bernoulli sample; with keys it is decided by their hash and so repeatable."""
    if keys is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.where(_hash32(keys, seed) < F.lit(int(fraction * 2**32)))


def sample_n(df: DataFrame, n: int, keys, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all, if fewer), chosen by hash order."""
    return df.orderBy(_hash32(keys, seed), *keys).limit(n)
