"""Grouped aggregates.

Totals are computed by an aggregate with map-side partial sums and joined back, never
by a window over a whole period, so no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.functions import periods

# Topics that make up each job category.
JOB_CATEGORIES = {
    "All": list(range(30)),
    "Public Transit Staff": [1, 5, 19, 22, 24],
    "Transporter": [18],
    "Security": [23],
    "Blue Collar": [1, 5, 19, 22, 24, 0, 3, 4, 7, 11, 12, 17, 18, 25, 26, 29],
    "Factory Worker": [0, 3, 4, 7, 11, 12, 17, 25, 26, 29],
    "Clerk": [8, 27],
    "Merchandiser": [14],
    "Salesman": [20, 28],
    "Beautician": [15],
    "Designer": [9],
    "Manager": [2, 16],
    "Engineer": [21],
    "White Collar": [2, 9, 16, 21],
}


def count_by(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("cnt"))


def sum_by(df: DataFrame, keys, columns) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def mean_by(df: DataFrame, keys, columns) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def distinct_rows(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns).distinct() if columns else df.distinct()


OD_KEYS = ("event_date", "province_from", "city_from", "province_to", "city_to")


def user_day_od_count(trips: DataFrame, keys=OD_KEYS, user: str = "userid") -> DataFrame:
    """Distinct users per day, origin and destination.

    Spark first removes duplicate users inside each map task, then spreads a day and
    pair over tasks by user, so a pair with a third of all trips stays parallel.
    """
    return trips.groupBy(*keys).agg(F.count_distinct(user).alias("cnt"))


def count_sum_rate(df: DataFrame, key: str, label: str, exclude: str | None = "Others") -> DataFrame:
    """Count, sum and their quotient per class."""
    if exclude is not None:
        df = df.where(F.col(key) != exclude)
    grouped = df.groupBy(key).agg(F.count(label).alias("n"), F.sum(label).alias("positives"))
    return grouped.withColumn("precision", F.try_divide(F.col("positives"), F.col("n")))


def global_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.sum(column).alias("total"), F.min(column).alias("minimum"),
        F.max(column).alias("maximum"), F.count(column).alias("n"),
    )


def attach(df: DataFrame, totals: DataFrame, keys) -> DataFrame:
    """Join group totals back. Without keys the totals are one row, which is broadcast."""
    if keys:
        return df.join(totals, list(keys))
    one = F.broadcast(totals.withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


def share_of_group(df: DataFrame, keys, value: str = "cnt", out: str = "ratio") -> DataFrame:
    """Value over the sum of its group."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return attach(df, totals, keys).withColumn(out, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def weighted_mean(df: DataFrame, keys, value: str, weight: str, out: str = "weighted_mean") -> DataFrame:
    product = F.sum(F.col(value) * F.col(weight))
    return df.groupBy(*keys).agg(F.try_divide(product, F.sum(weight)).alias(out))


def ratio_of_sums(df: DataFrame, keys, numerators, denominator: str) -> DataFrame:
    """Summed columns over one summed base column, one output column each."""
    return df.groupBy(*keys).agg(
        *[F.try_divide(F.sum(c), F.sum(denominator)).alias(c) for c in numerators]
    )


def category_rows(spark, categories=None) -> DataFrame:
    """Category map as rows (category, topic)."""
    rows = [(c, t) for c, topics in (categories or JOB_CATEGORIES).items() for t in topics]
    return spark.createDataFrame(rows, "category string, topic int")


def category_sum(topic_counts: DataFrame, categories=None, base: str = "All", keys=("name", "time")) -> DataFrame:
    """Topic counts summed into overlapping categories, with their share per period.

    One pass: a conditional sum per category. Rows are those with a count in the base
    category; a category a place lacks is 0.
    """
    categories = categories or JOB_CATEGORIES
    topic, cnt = F.col("topic"), F.col("cnt")
    in_base = topic.isin(categories[base])
    sums = [
        F.sum(F.when(topic.isin(topics), cnt).otherwise(F.lit(0))).cast("double").alias(f"jd_{name}")
        for name, topics in categories.items()
    ]
    wide = (
        topic_counts.groupBy(*keys)
        .agg(*sums, F.max(in_base).alias("_in_base"))
        .where("_in_base").drop("_in_base")
    )
    names = [f"jd_{name}" for name in categories]
    # The share of a period counts every place, also those outside the base rows.
    totals = topic_counts.groupBy("time").agg(
        *[
            F.sum(F.when(topic.isin(topics), cnt)).cast("double").alias(f"_total_{name}")
            for name, topics in categories.items()
        ]
    )
    shares = {
        f"{n}_norm": F.coalesce(F.try_divide(F.col(n), F.col(n.replace("jd_", "_total_", 1))), F.lit(0.0))
        for n in names
    }
    return wide.join(totals, "time").withColumns(shares).drop(*[c for c in totals.columns if c != "time"])


def category_long(topic_counts: DataFrame, categories=None, keys=("name", "time")) -> DataFrame:
    """Long form (keys, category, count): topics meet their categories by a join."""
    pairs = category_rows(topic_counts.sparkSession, categories)
    pre = topic_counts.groupBy(*keys, "topic").agg(F.sum("cnt").alias("cnt"))
    return pre.join(pairs, "topic").groupBy(*keys, "category").agg(F.sum("cnt").alias("cnt"))


def present_in_all_periods(df: DataFrame, periods_, key: str = "name", time: str = "time") -> DataFrame:
    periods_ = list(periods_)
    return (
        df.where(F.col(time).isin(periods_))
        .groupBy(key).agg(F.count_distinct(time).alias("_n"))
        .where(F.col("_n") == len(periods_)).select(key)
    )


def per_mille_norm(df: DataFrame, columns, scope: str = "country") -> DataFrame:
    """Columns times 1000 over their total per period, or per period and place."""
    keys = ["time"] if scope == "country" else ["time", "name"]
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_total_{c}") for c in columns])
    out = {
        f"{c}_{scope}_norm": F.try_divide(F.col(c) * F.lit(1000.0), F.col(f"_total_{c}")) for c in columns
    }
    result = df.join(totals, keys).withColumns(out).drop(*[f"_total_{c}" for c in columns])
    if "flow_in" in columns and "flow_out" in columns:
        net = F.col(f"flow_in_{scope}_norm") - F.col(f"flow_out_{scope}_norm")
        result = result.withColumn(f"flow_in_net_{scope}_norm", net)
    return result


def flow_norm_with_self(centrality: DataFrame, edges_with_self: DataFrame) -> DataFrame:
    """In, out and net flow over all flow of the period, self edges included."""
    totals = edges_with_self.groupBy("time").agg(F.sum("cnt").alias("_total"))
    columns = ["flow_in", "flow_out", "flow_in_net"]
    return centrality.join(totals, "time").withColumns(
        {f"{c}_norm_with_selfflow": F.try_divide(F.col(c), F.col("_total")) for c in columns}
    ).drop("_total")


def array_sum_by(df: DataFrame, keys, array: str) -> DataFrame:
    """Element-wise sum of arrays, as long as the longest of the group; each position is summed
    map-side."""
    keys = list(keys)
    parts = df.select(*keys, F.posexplode(array).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.sum("_x").alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_x")))  # one entry per position
    return parts.groupBy(*keys).agg(F.transform(ordered, lambda p: p["_x"]).alias(array))


def sparse_to_dense(indexes, values, length: int):
    """Index/value arrays to a dense array; repeated indexes add up. One pass over the pairs."""
    pairs = F.arrays_zip(F.col(indexes).alias("i"), F.col(values).alias("v"))
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>"))
    sums = F.aggregate(
        pairs, empty,
        lambda m, p: F.map_concat(
            F.map_filter(m, lambda k, _: k != p["i"]),
            F.create_map(p["i"].cast("int"), F.coalesce(F.try_element_at(m, p["i"].cast("int")), F.lit(0.0)) + p["v"].cast("double")),
        ),
    )
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda at: F.coalesce(F.try_element_at(sums, at), F.lit(0.0)))


def pivot_wide(df: DataFrame, key, column: str, values, value: str) -> DataFrame:
    """One column per listed value; a key that repeats shows its largest value."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.max(value))


def unpivot_long(df: DataFrame, ids, columns, name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def multi_grain_rollup(daily: DataFrame) -> DataFrame:
    """Daily flow at months, quarters and the whole period, for provinces and cities.

    The fact is first summed to month and city pair; the six outputs come from one
    grouping-sets aggregate over that much smaller table.
    """
    monthly = daily.groupBy(
        periods.month_str("event_date").alias("month"),
        periods.season_str("event_date").alias("season"),
        "province_from", "city_from", "province_to", "city_to",
    ).agg(F.sum("cnt").alias("cnt"))
    places = {"province": ("province_from", "province_to"), "city": ("city_from", "city_to")}
    sets = [
        [F.col(c) for c in (*period, *pair)]
        for period in (("month",), ("season",), ())
        for pair in places.values()
    ]
    columns = ["month", "season", "province_from", "province_to", "city_from", "city_to"]
    rolled = monthly.groupingSets(sets, *columns).agg(
        F.sum("cnt").alias("cnt"),
        F.grouping("month").alias("no_month"),
        F.grouping("season").alias("no_season"),
        F.grouping("city_from").alias("no_city"),
    )
    by_city = F.col("no_city") == 0
    grain = F.when(F.col("no_month") == 0, "month").when(F.col("no_season") == 0, "season").otherwise("all")
    return rolled.select(
        grain.alias("grain"),
        F.when(by_city, "city").otherwise("province").alias("coarse"),
        F.coalesce("month", "season", F.lit("all")).alias("time"),
        F.when(by_city, F.col("city_from")).otherwise(F.col("province_from")).alias("src"),
        F.when(by_city, F.col("city_to")).otherwise(F.col("province_to")).alias("dst"),
        "cnt",
    )
