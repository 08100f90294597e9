"""File readers and sinks. All schemas are declared, all reads stay lazy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflux import schemas
from odflux.functions import periods

SENTINEL = "NuLL"  # Fixed value: stands for "any" or "unknown" in place columns.


def scan_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated search log; only the five used positions are parsed."""
    return (
        spark.read.schema(schemas.EVENT_LOG)
        .option("sep", "\t")
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .csv(path)
        .select("query", "location", "title", "userid", "stamp")
    )


def scan_posts(posts: DataFrame, columns, date_prefixes) -> DataFrame:
    """Chosen columns of the posts whose start date begins with any prefix.

    The prefixes become ``StartsWith`` predicates, which Parquet and ORC scans
    receive; rows with a null in a chosen column are dropped.
    """
    wanted = reduce(lambda a, b: a | b, [F.col("startdate").startswith(p) for p in date_prefixes])
    return posts.where(wanted).select(*columns).na.drop()


def write_transitions(daily: DataFrame, path: str) -> None:
    """Daily flow partitioned by month, one directory per month.

    The rebalance hint lets adaptive execution split large months and merge small ones.
    """
    (
        daily.withColumn("month", periods.month_str("event_date"))
        .hint("rebalance", F.col("month"))
        .write.mode("overwrite")
        .partitionBy("month")
        .parquet(path)
    )


def scan_transitions(spark: SparkSession, path: str, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Months of a range; only their directories are read."""
    low, high = periods.period_bounds(start, end, "month")
    table = spark.read.schema(schemas.TRANSITIONS).parquet(path)
    return table.where(F.col("month").between(low, high))


def scan_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily transitions as text, dates without padding (``2020-1-5``)."""
    raw = spark.read.schema(schemas.DAILY_FLOW).option("header", True).csv(path)
    return raw.select(
        F.to_date(F.try_to_timestamp("time", F.lit("yyyy-M-d"))).alias("event_date"),
        "province_from", "city_from", "province_to", "city_to",
        F.col("count").alias("cnt"),
    )


def scan_flow_graph(spark: SparkSession, path: str, self_edge: bool = False) -> DataFrame:
    """Prepared edge list ``time, from, to, count``."""
    raw = spark.read.schema(schemas.FLOW_GRAPH).option("header", True).csv(path)
    return clean_edges(
        raw.select("time", F.col("from").alias("src"), F.col("to").alias("dst"), F.col("count").alias("cnt")),
        self_edge,
    )


def scan_typed_graph(spark: SparkSession, path: str, coarse: str, self_edge: bool = False) -> DataFrame:
    """Prepared typed transitions at one place level, summed per edge and type."""
    raw = spark.read.schema(schemas.TYPED_TRANSITIONS).option("header", True).csv(path)
    edges = raw.select(
        "time", "value",
        F.col(f"{coarse}_from").alias("src"), F.col(f"{coarse}_to").alias("dst"),
        F.col("count").alias("cnt"),
    )
    return clean_edges(edges, self_edge).groupBy("time", "value", "src", "dst").agg(F.sum("cnt").alias("cnt"))


def clean_edges(edges: DataFrame, self_edge: bool = False) -> DataFrame:
    """Edges between known places, by default without self edges."""
    known = edges.where((F.col("src") != SENTINEL) & (F.col("dst") != SENTINEL))
    return known if self_edge else known.where(F.col("src") != F.col("dst"))


# ---- small reference tables --------------------------------------------------

def _dimension(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_tier(spark: SparkSession, path: str) -> DataFrame:
    return _dimension(spark, path, schemas.CITY_TIER).select(F.col("city").alias("name"), F.col("level").alias("tier"))


def scan_translation(spark: SparkSession, path: str) -> DataFrame:
    return _dimension(spark, path, schemas.TRANSLATION)


def scan_location(spark: SparkSession, path_ll: str, path_mc: str, coarse: str = "km") -> DataFrame:
    """Both coordinate systems by name; projected metres scaled to kilometres."""
    scale = 1000.0 if coarse == "km" else 1.0
    planar = _dimension(spark, path_mc, schemas.LOCATION_MC).select(
        "name", (F.col("mc_x") / scale).alias("mc_x"), (F.col("mc_y") / scale).alias("mc_y")
    )
    return _dimension(spark, path_ll, schemas.LOCATION_LL).join(planar, "name")


def scan_areas(spark: SparkSession, path: str) -> DataFrame:
    """City to province, sentinel cities dropped."""
    return _dimension(spark, path, schemas.AREAS).where(F.col("city") != SENTINEL)


def scan_gdp(spark: SparkSession, path: str) -> DataFrame:
    """Known values only: a missing value reads as -1 and is dropped."""
    return _dimension(spark, path, schemas.GDP).na.fill(-1.0, ["gdp"]).where(F.col("gdp") != -1.0)


def scan_city_statistics(spark: SparkSession, path: str) -> DataFrame:
    return _dimension(spark, path, schemas.CITY_STATISTICS)


def scan_area_dictionary(spark: SparkSession, path: str, coarse_bottom: str = "region") -> DataFrame:
    """Word to area rows, down to a place level; sentinels become nulls."""
    level = {"province": 0, "city": 1, "region": 2}[coarse_bottom]
    rows = spark.read.schema(schemas.AREA_DICTIONARY).parquet(path)
    return rows.where(F.col("level") <= level).select(
        "word",
        *[F.nullif(F.col(c), F.lit(SENTINEL)).alias(c) for c in ("province", "city", "region")],
        "level", "x", "y", "original_level",
    )


def scan_grid_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GRID_DICTIONARY).parquet(path)


def scan_geojson_centers(spark: SparkSession, path: str) -> DataFrame:
    """Feature names and centres; empty names are skipped."""
    features = (
        spark.read.schema(schemas.GEOJSON)
        .option("multiLine", True)
        .json(path)
        .select(F.explode("features").alias("f"))
    )
    return features.select(
        F.col("f.properties.name").alias("name"),
        F.try_element_at("f.properties.center", F.lit(1)).alias("center_x"),
        F.try_element_at("f.properties.center", F.lit(2)).alias("center_y"),
    ).where(F.col("name") != "")


# ---- sinks -------------------------------------------------------------------

def write_partitioned_csv(df: DataFrame, path: str, parts: int = 100, header: bool = False) -> None:
    """Text sink with a fixed number of evenly filled files."""
    df.repartition(parts).write.mode("overwrite").option("header", header).csv(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Result table as Parquet or CSV with header."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
