"""Ranks and exact order statistics that never sort a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.operators.aggregates import attach
from odflux.session import materialize

CHUNK_ROWS = 100_000  # different values that one task sorts


def settled(df: DataFrame, value: str) -> DataFrame:
    """The table itself, or a written copy when the value is a floating-point result.

    A sum of doubles may differ in its last bit when it is computed again. The ranks
    compare values of several branches, so these must read one written copy.
    """
    return materialize(df, "settled") if dict(df.dtypes)[value] in ("double", "float") else df


def _chunk_of(value, bounds):
    """How many of the ascending bounds lie below the value, by halving: the search takes as
    many steps as the number of bounds has bits."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bounds) + F.lit(1.0))).cast("int"))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    below = lambda s: F.get(bounds, middle(s)) < value
    found = F.aggregate(steps, start, lambda s, _: F.when(
        s["lo"] >= s["hi"], s
    ).otherwise(F.struct(
        F.when(below(s), middle(s) + 1).otherwise(s["lo"]).alias("lo"),
        F.when(below(s), s["hi"]).otherwise(middle(s)).alias("hi"),
    )))
    return found["lo"]


def positions(df: DataFrame, keys, value: str) -> DataFrame:
    return _positions(settled(df.select(*keys, value), value), keys, value)


def _positions(df: DataFrame, keys, value: str) -> DataFrame:
    """Distinct values of each group with their frequency and sorted position.

    Columns: keys, value, ``n`` (rows with this value), ``before`` (rows with smaller
    values) and ``total``. Equal values are merged first. The values of a group are cut
    into chunks of about ``CHUNK_ROWS`` values at quantiles of a sketch, so that chunks
    hold alike many also if values are heavy-tailed. Chunks are sorted separately, and
    their sums give each chunk its offset. Any bounds give exact ranks; they are written
    once, so all attempts use the same.
    """
    keys = list(keys)
    merged = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    merged = materialize(merged, "merged")
    spans = merged.groupBy(*keys).agg(F.count("*").alias("_values"), F.sum("n").alias("total"))
    largest = spans.agg(F.max("_values")).first()[0] or 1
    chunks = max(1, -(-int(largest) // CHUNK_ROWS))
    points = [k / chunks for k in range(1, chunks)] or [0.5]
    bounds = merged.groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), points, F.lit(max(10000, 10 * chunks))).alias("_bounds")
    )
    span = materialize(attach(spans, bounds, keys).drop("_values"), "bounds")
    chunk = _chunk_of(F.col(value).cast("double"), F.col("_bounds"))
    placed = attach(merged, span, keys).withColumn("_chunk", chunk).drop("_bounds")

    sums = placed.groupBy(*keys, "_chunk").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))

    inside = Window.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, [*keys, "_chunk"])
        .select(*keys, value, "n", (F.col("_start") + F.col("_inside")).alias("before"), "total")
    )


def average_rank(df: DataFrame, keys, score: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """Rank inside the group, ties averaged; rows without a score get no rank."""
    keys = list(keys)
    df = settled(df, score)
    after = F.col("total") - F.col("before") - F.col("n")
    ahead = after if descending else F.col("before")
    ranks = _positions(df, keys, score).select(*keys, score, (ahead + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, [*keys, score], "left")


def average_rank_desc(df: DataFrame, keys, score: str, out: str = "rank") -> DataFrame:
    return average_rank(df, keys, score, out, descending=True)


def quantiles(df: DataFrame, keys, value: str, points) -> DataFrame:
    """Exact quantiles with linear interpolation, columns ``q_<point>``."""
    return _quantiles(positions(df, keys, value), keys, value, points)


def _quantiles(table: DataFrame, keys, value: str, points) -> DataFrame:
    def at(index):
        hit = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    columns = []
    for p in points:
        place = (F.col("total") - 1) * F.lit(float(p))
        columns += [at(F.floor(place)).alias(f"_lo_{p}"), at(F.ceil(place)).alias(f"_hi_{p}")]
    found = table.groupBy(*keys).agg(F.max("total").alias("n"), *columns)
    part = lambda p: (F.col("n") - 1) * F.lit(float(p)) % 1
    return found.select(
        *keys, "n",
        *[
            (F.col(f"`_lo_{p}`") + (F.col(f"`_hi_{p}`") - F.col(f"`_lo_{p}`")) * part(p)).alias(f"q_{p}")
            for p in points
        ],
    )


def median(df: DataFrame, keys, value: str, out: str = "median") -> DataFrame:
    return quantiles(df, keys, value, (0.5,)).select(*keys, F.col("`q_0.5`").alias(out))


def five_number_summary(df: DataFrame, keys, value: str) -> DataFrame:
    """Minimum, quartiles, maximum and the whiskers at 1.5 quartile ranges."""
    keys = list(keys)
    df = settled(df.select(*keys, value), value)
    box = _quantiles(_positions(df, keys, value), keys, value, (0.0, 0.25, 0.5, 0.75, 1.0)).select(
        *keys, "n",
        F.col("`q_0.0`").alias("minimum"), F.col("`q_0.25`").alias("q1"), F.col("`q_0.5`").alias("median"),
        F.col("`q_0.75`").alias("q3"), F.col("`q_1.0`").alias("maximum"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    whiskers = (
        attach(df, box.select(*keys, "q1", "q3"), keys)
        .where(inside)
        .groupBy(*keys)
        .agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    )
    return attach(box, whiskers, keys)


def top_n_ranking(df: DataFrame, metric: str, time: str, n: int = 100, digits: int = 4) -> DataFrame:
    """Highest n places of one period with their rank; ties by name."""
    best = df.where(F.col("time") == time).select("name", metric).orderBy(F.desc_nulls_last(metric), "name").limit(n)
    # At most n rows are left for the numbering.
    order = Window.orderBy(F.desc_nulls_last(metric), "name")
    return best.withColumn("rank", F.row_number().over(order)).withColumn(metric, F.round(metric, digits))


def rank_mismatch(df: DataFrame, demand: str = "rank_demand", supply: str = "rank_supply", prefix: str = "", suffix: str = "") -> DataFrame:
    gap = F.col(demand) - F.col(supply)
    return df.withColumns(
        {
            f"{prefix}mismatch{suffix}": F.abs(gap),
            f"{prefix}demand_lack{suffix}": F.greatest(gap, F.lit(0.0)),
            f"{prefix}supply_lack{suffix}": F.greatest(-gap, F.lit(0.0)),
        }
    )


def top_k_by_rank(df: DataFrame, rank: str, k: int = 10) -> DataFrame:
    return df.where(F.col(rank) <= k)
