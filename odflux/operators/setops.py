"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.operators.filters import vertices_of


def append(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def intersect_places(edges: DataFrame, locations: DataFrame) -> DataFrame:
    """Places that have both an edge and a location."""
    return vertices_of(edges).intersect(locations.select("name"))


def vertices(edges: DataFrame, by=()) -> DataFrame:
    return vertices_of(edges, by)


def carry_forward_year(stats: DataFrame, source: int, target: int, column: str = "year") -> DataFrame:
    """Repeat one year's rows as another year's."""
    kind = stats.schema[column].dataType
    copy = stats.where(F.col(column) == source).withColumn(column, F.lit(target).cast(kind))
    return stats.unionByName(copy)


def remove_members(members: DataFrame, subset: DataFrame, keys) -> DataFrame:
    return members.join(subset.select(*keys), list(keys), "left_anti")
