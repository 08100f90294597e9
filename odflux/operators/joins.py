"""Joins. No side carries a broadcast hint: Spark broadcasts what it knows is small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.functions import scalars


def grid_lookup(points: DataFrame, grid: DataFrame, length: int = 2000, x: str = "x", y: str = "y") -> DataFrame:
    """Place of the grid cell a point falls in; points outside all cells are dropped."""
    return points.withColumn("grid_id", scalars.grid_id(x, y, length)).join(grid, "grid_id")


def lookup_default(
    df: DataFrame, dim: DataFrame, key: str, value: str, default=-1, keep: bool = False, dim_key: str = "name"
) -> DataFrame:
    """Attach a dimension value; unknown keys are removed, or kept with a default."""
    pairs = dim.select(F.col(dim_key).alias(key), value)
    if not keep:
        return df.join(pairs, key)
    return df.join(pairs, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def lookup_strict(df: DataFrame, dim: DataFrame, key: str, value: str, dim_key: str = "name") -> DataFrame:
    """Attach a dimension value; a missing key is an error when the row is computed."""
    pairs = dim.select(F.col(dim_key).alias(key), F.col(value).alias("_found"))
    missing = F.raise_error(F.concat(F.lit(f"no {value} for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    kind = dict(dim.dtypes)[value]
    return (
        df.join(pairs, key, "left")
        .withColumn(value, F.coalesce(F.col("_found"), missing.cast(kind)))
        .drop("_found")
    )


def inner_join(a: DataFrame, b: DataFrame, keys, suffixes=("_x", "_y")) -> DataFrame:
    """Equi join; other columns of the same name get suffixes."""
    shared = (set(a.columns) & set(b.columns)) - set(keys)
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, list(keys))


def full_outer_fill(a: DataFrame, b: DataFrame, keys, value=0) -> DataFrame:
    return a.join(b, list(keys), "full_outer").na.fill(value)


def left_join_fill(a: DataFrame, b: DataFrame, keys, value=0) -> DataFrame:
    return a.join(b, list(keys), "left").na.fill(value)


def join_on_year_and_city(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """Wages of both ends in the edge's year.

    The source needs a wage; a missing wage at the target counts as no difference.
    """
    source = stats.select("year", F.col("name").alias("src"), F.col("wage").alias("src_wage"))
    target = stats.select("year", F.col("name").alias("dst"), F.col("wage").alias("dst_wage"))
    return (
        edges.join(source, ["year", "src"])
        .join(target, ["year", "dst"], "left")
        .withColumn("wage_diff", F.coalesce(F.col("dst_wage") - F.col("src_wage"), F.lit(0.0)))
    )


def compare_periods(df: DataFrame, key: str, value: str, periods, time: str = "time") -> DataFrame:
    """One column per period, for keys present in every period; one shuffle, no self joins.

    A key that repeats in a period shows its largest value."""
    wide = df.where(F.col(time).isin(list(periods))).groupBy(key).pivot(time, list(periods)).agg(F.max(value))
    return wide.where(reduce(lambda a, b: a & b, [F.col(f"`{p}`").isNotNull() for p in periods]))


def nearest_candidate(candidates: DataFrame, keys, x0: str, y0: str, x1: str, y1: str, tie_keys) -> DataFrame:
    """Closest candidate of each key, by a mergeable minimum instead of a sort."""
    others = [c for c in candidates.columns if c not in keys and c not in tie_keys]
    best = F.min(
        F.struct(
            scalars.squared_distance(x0, y0, x1, y1).alias("d2"),
            *[F.col(c) for c in tie_keys],
            *[F.col(c) for c in others],
        )
    ).alias("best")
    return candidates.groupBy(*keys).agg(best).select(*keys, "best.*")


def near_pairs(places: DataFrame, radius: float, seeds: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of places closer than a radius, each place with itself included.

    Places meet through an equi join on grid cells as wide as the radius, so only
    places of the same or a neighbouring cell are compared.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    left = (places if seeds is None else places.join(seeds.select("name"), "name", "left_semi")).select(
        F.col("name").alias("name_a"), F.col("mc_x").alias("xa"), F.col("mc_y").alias("ya"),
        cell("mc_x").alias("gx0"), cell("mc_y").alias("gy0"),
    )
    left = left.withColumn("sx", around).withColumn("sy", around).select(
        "name_a", "xa", "ya", (F.col("gx0") + F.col("sx")).alias("gx"), (F.col("gy0") + F.col("sy")).alias("gy")
    )
    right = places.select(
        F.col("name").alias("name_b"), F.col("mc_x").alias("xb"), F.col("mc_y").alias("yb"),
        cell("mc_x").alias("gx"), cell("mc_y").alias("gy"),
    )
    return (
        left.join(right, ["gx", "gy"])
        .withColumn("distance", scalars.euclid("xa", "ya", "xb", "yb"))
        .where(F.col("distance") < radius)
        .select("name_a", "name_b", "distance")
    )


def find_near(places: DataFrame, seeds: DataFrame, radius: float) -> DataFrame:
    return near_pairs(places, radius, seeds)


def edge_distances(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Planar length of every edge."""
    end = lambda side: places.select(
        F.col("name").alias(side), F.col("mc_x").alias(f"{side}_x"), F.col("mc_y").alias(f"{side}_y")
    )
    return (
        edges.join(end("src"), "src").join(end("dst"), "dst")
        .withColumn("distance", scalars.euclid("src_x", "src_y", "dst_x", "dst_y"))
        .drop("src_x", "src_y", "dst_x", "dst_y")
    )
