"""Orderings and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_by(df: DataFrame, keys) -> DataFrame:
    return df.orderBy(*keys)


def top_k(df: DataFrame, column: str, k: int, tie_keys=("name",)) -> DataFrame:
    """Highest k rows; ties are settled by the tie keys."""
    return df.orderBy(F.desc_nulls_last(column), *tie_keys).limit(k)


def timeline(df: DataFrame, column: str = "time") -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def order_by_list(df: DataFrame, column: str, order, then=()) -> DataFrame:
    """Rows in the order of a list; the position stays as a sort key column."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.withColumn(f"{column}_id", position.cast("int")).orderBy(f"{column}_id", *then)
