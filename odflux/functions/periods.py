"""Period labels: ``yyyyMM`` months, ``yyyyQn`` quarters and ``all``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAINS = ("month", "season", "all")


def month_str(date) -> Column:
    return F.date_format(date, "yyyyMM")


def season_str(date) -> Column:
    date = F.col(date) if isinstance(date, str) else date
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def period_label(date, grain: str) -> Column:
    if grain == "month":
        return month_str(date)
    if grain == "season":
        return season_str(date)
    if grain == "all":
        return F.lit("all")
    raise ValueError(f"unknown time grain {grain!r}")


def parse_compact_timestamp(text) -> Column:
    """14-digit text to timestamp, null when it does not parse."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike("^[0-9]{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def timestamp_parts(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns(
        {
            "year": F.year(column),
            "month": F.month(column),
            "day": F.dayofmonth(column),
            "hour": F.hour(column),
        }
    )


def month_timeline(spark: SparkSession, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Inclusive list of month labels."""
    first, last = (F.make_date(F.lit(y), F.lit(m), F.lit(1)) for y, m in (start, end))
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("d")).select(month_str("d").alias("time"))


def period_to_date(label) -> Column:
    """First day of a month or quarter label."""
    label = F.col(label) if isinstance(label, str) else label
    quarter_month = F.try_element_at(F.split(label, "Q"), F.lit(2)).try_cast("int") * 3 - 2
    return F.when(
        label.contains("Q"),
        F.make_date(F.substring(label, 1, 4).try_cast("int"), quarter_month, F.lit(1)),
    ).otherwise(F.to_date(F.try_to_timestamp(label, F.lit("yyyyMM"))))


def period_year(label) -> Column:
    return F.substring(label, 1, 4).try_cast("int")


def label_of(year: int, month: int, grain: str) -> str:
    return f"{year}{month:02d}" if grain == "month" else f"{year}Q{(month - 1) // 3 + 1}"


def period_bounds(start: tuple[int, int], end: tuple[int, int], grain: str) -> tuple[str, str]:
    """First and last label of the requested range."""
    return label_of(*start, grain), label_of(*end, grain)
