"""Column projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.functions import scalars


def project(df: DataFrame, rename=None, drop=(), constants=None, rounding=None, order=None) -> DataFrame:
    """Rename, drop, add constants, round and reorder, in this order."""
    df = df.withColumnsRenamed(rename or {}).drop(*drop)
    if constants:
        df = df.withColumns({name: F.lit(value) for name, value in constants.items()})
    if rounding:
        df = df.withColumns({name: F.round(name, digits) for name, digits in rounding.items()})
    return df.select(*order) if order else df


def size_class(df: DataFrame, column: str, metric: str, out: str = "size_class") -> DataFrame:
    return df.withColumn(out, scalars.bucket_by_bounds(column, scalars.SIZE_BOUNDS[metric]))


def expand_alias(df: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """Places that have an alias also emit a row under that alias, in one pass."""
    known = aliases.groupBy(F.col("name").alias(column)).agg(F.collect_set("alias").alias("_aliases"))
    names = F.concat(F.array(column), F.coalesce("_aliases", F.array().cast("array<string>")))
    return (
        df.join(known, column, "left").withColumn("_name", F.explode(names))
        .withColumn(column, F.col("_name")).select(*df.columns)
    )
