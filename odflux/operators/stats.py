"""Correlation, standard scores and classification metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflux.operators.aggregates import attach
from odflux.operators.ranking import CHUNK_ROWS, average_rank, positions
from odflux.session import materialize


def zscore(df: DataFrame, columns, keys=()) -> DataFrame:
    """(x - mean) / sample standard deviation over all rows, or per group."""
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"_sd_{c}") for c in columns],
    )
    scored = {c: F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_sd_{c}")) for c in columns}
    return attach(df, stats, keys).withColumns(scored).select(*df.columns)


def pearson(df: DataFrame, columns, target: str) -> DataFrame:
    """One row per column; all coefficients come from a single aggregate."""
    wide = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "metric", "coefficient")


def _ranked(df: DataFrame, columns, target: str) -> DataFrame:
    ranked = df
    for c in (target, *columns):
        ranked = average_rank(ranked, [], c, f"_r_{c}", descending=False)
    return ranked.select(*[F.col(f"_r_{c}").alias(c) for c in (target, *columns)])


def spearman(df: DataFrame, columns, target: str) -> DataFrame:
    """Pearson on average ranks."""
    return pearson(_ranked(df, columns, target), columns, target)


def _inversions(value: np.ndarray, weight: np.ndarray) -> int:
    """Sum of the weight products of all pairs whose earlier value is the larger one, bit by bit:
    two values that agree in all higher bits are an inversion if the earlier one has a 1."""
    code = np.unique(value, return_inverse=True)[1]
    if int(weight.sum()) >> 31:
        weight = weight.astype(object)  # products beyond 64 bits
    total = 0
    for bit in range(int(code.max(initial=0)).bit_length()):
        order = np.argsort(code >> (bit + 1), kind="stable")
        cell, one, w = code[order] >> (bit + 1), (code[order] >> bit) & 1, weight[order]
        ones = np.cumsum(w * one)
        first = np.searchsorted(cell, cell)
        ahead = ones - np.concatenate(([0], ones))[first]
        total += int((ahead * w * (1 - one)).sum())
    return total


def _inside(order: tuple[str, str], value: tuple[str, ...]):
    """Inversions of the ``value`` columns among the points of a chunk, taken in ``order``."""

    def run(part: pa.Table) -> pa.Table:
        column = {c: part.column(c).to_numpy() for c in {*order, *value, "k"}}
        place = np.lexsort([column[c] for c in reversed(order)])
        # One number per value: its place in the order of the columns.
        by = np.lexsort([column[c] for c in reversed(value)])
        change = np.zeros(len(by), bool)
        for c in value:
            change[1:] |= column[c][by][1:] != column[c][by][:-1]
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(change)
        found = _inversions(number[place], column["k"][place])
        return pa.table({"metric": part.column("metric")[:1], "q": pa.array([str(found)], pa.string())})

    return run


def _between(points: DataFrame) -> DataFrame:
    """Inversions of points that share neither chunk, (metric, q), from the weights of the cells
    that two chunks make.

    Two chunks of x first differ in one bit of their numbers, so each cell meets the others once
    per bit; a window runs over the chunks of y, not over points.
    """
    cells = points.groupBy("metric", "gx", "gy").agg(F.sum("k").alias("k"))
    number = F.row_number().over(Window.partitionBy("metric").orderBy("gx")) - 1
    chunks = points.select("metric", "gx").distinct().withColumn("i", number)
    width = chunks.groupBy("metric").agg(F.max("i").alias("_last"))
    bits = F.sequence(F.lit(0), F.length(F.bin("_last")) - 1)
    levels = cells.join(chunks.join(width, "metric"), ["metric", "gx"]).withColumn("bit", F.explode(bits))
    side = lambda b: F.sum(F.when(F.expr("shiftright(i, bit) & 1") == b, F.col("k")).otherwise(F.lit(0)))
    lines = levels.groupBy("metric", "bit", F.expr("shiftright(i, bit + 1)").alias("half"), "gy").agg(
        side(0).alias("low"), side(1).alias("high")
    )
    above = Window.partitionBy("metric", "bit", "half").orderBy(F.desc("gy")).rowsBetween(Window.unboundedPreceding, -1)
    crossed = lines.select("metric", "high", F.coalesce(F.sum("low").over(above), F.lit(0)).alias("ahead"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    return crossed.groupBy("metric").agg(F.sum(exact("high") * exact("ahead")).cast("decimal(38,0)").alias("q"))


def kendall(df: DataFrame, columns, target: str, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Kendall tau-b over all rows.

    Discordant pairs are the inversions between two orders of the different points: by (x, y) and
    by (y, x). Both are cut into chunks of at most about two times ``chunk`` points; a value with
    more rows than ``chunk`` is cut by the other coordinate. A pair shares its chunk of x, or else
    its chunk of y, and is counted there; or it shares neither and is counted from the weights of
    the cells. Concordant pairs follow from the counts of ties. A point is in one chunk of each
    kind, and cells are at most (rows / chunk) squared, so the work grows with the rows up to
    chunk squared of them. All counts are whole numbers.
    """
    long = df.unpivot([target], list(columns), "metric", "x").withColumnRenamed(target, "y")
    long = materialize(long.where(F.col("x").isNotNull() & F.col("y").isNotNull()), "pairs")
    points = long.groupBy("metric", "x", "y").agg(F.count("*").alias("k"))
    codes = {}
    for c in ("x", "y"):
        found = positions(long, ["metric"], c)
        codes[c] = materialize(found.select("metric", c, F.col("before").alias(f"c{c}"), F.col("n").alias(f"n{c}"), "total"), f"codes_{c}")
        points = points.join(codes[c] if c == "x" else codes[c].drop("total"), ["metric", c])
    slot = lambda c: F.expr(f"c{c} div {int(chunk)}")

    def group(c, other):
        parts = F.expr(f"total div {int(chunk)}") + 2
        return slot(c) * parts + F.when(F.col(f"n{c}") > chunk, slot(other) + 1).otherwise(F.lit(0))

    points = materialize(points.select("metric", "cx", "cy", "k", group("x", "y").alias("gx"), group("y", "x").alias("gy")), "points")
    kind = "metric string, q string"
    same_x = points.groupBy("metric", "gx").applyInArrow(_inside(("cx", "cy"), ("cy", "cx")), kind)
    same_y = points.groupBy("metric", "gy").applyInArrow(_inside(("cy", "cx"), ("gx",)), kind)
    whole = F.col("q").cast("decimal(38,0)").alias("q")
    inverted = same_x.unionByName(same_y).select("metric", whole).unionByName(_between(points))

    # Pairs of rows are counted twice: n * (n - 1) of n rows.
    twice = lambda n: F.sum(F.col(n).cast("decimal(19,0)") * (F.col(n) - 1).cast("decimal(19,0)"))
    table = inverted.groupBy("metric").agg(F.sum("q").alias("q"))
    for c in ("x", "y"):
        table = table.join(codes[c].groupBy("metric").agg(twice(f"n{c}").alias(f"ties_{c}"), F.max("total").alias(f"n_{c}")), "metric")
    table = table.join(points.groupBy("metric").agg(twice("k").alias("ties")), "metric").withColumnRenamed("n_x", "n")
    pairs = F.col("n").cast("decimal(19,0)") * (F.col("n") - 1).cast("decimal(19,0)")
    gap = (pairs - F.col("ties_x") - F.col("ties_y") + F.col("ties") - 4 * F.col("q")).cast("double")
    scale = F.sqrt((pairs - F.col("ties_x")).cast("double") * (pairs - F.col("ties_y")).cast("double"))
    return table.select("metric", "n", F.try_divide(gap, scale).alias("coefficient"))


def _beta_share(a: np.ndarray, b: float, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the regularised incomplete beta function, for x below its mean."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, rounds):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    log = np.array([math.lgamma(p + b) - math.lgamma(p) - math.lgamma(b) for p in a])
    with np.errstate(divide="ignore"):
        return np.exp(log + a * np.log(x) + b * np.log1p(-x)) * h / a


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation r over n rows, by the t distribution with n - 2
    degrees of freedom; the rows are the few metrics of a report."""
    r, nu = r.to_numpy(float), n.to_numpy(float) - 2
    usable = np.isfinite(r) & (nu > 0)
    r2, a = np.clip(np.where(usable, r * r, 0.0), 0.0, 1.0), np.where(usable, nu, 2.0) / 2
    x = 1 - r2  # p = I_x(nu / 2, 1 / 2)
    low = x < (a + 1) / (a + 2.5)
    direct = np.where(low & (x > 0), _beta_share(a, 0.5, np.where(low & (x > 0), x, 0.5)), 0.0)
    # Near x = 1 the complement converges.
    other = np.where(low, 0.5, r2)
    swapped = np.array([1 - _beta_share(np.array([0.5]), float(p), np.array([q]))[0] if q > 0 else 1.0 for p, q in zip(a, other)])
    p = np.where(low, direct, swapped)
    return pd.Series(np.where(usable, p, np.nan)).where(usable, None).astype("float64")


def _kendall_p_value(tau: str, n: str):
    """Normal approximation of the two-sided p-value, with the error function by its integral's
    continued fraction left to the correlation of large samples: erfc(z / sqrt 2) is the
    two-sided tail of a t distribution with very many degrees of freedom."""
    size = F.col(n).cast("double")
    z = F.col(tau) / F.sqrt(2 * (2 * size + 5) / (9 * size * (size - 1)))
    many = 1e9
    return F.when(size >= 2, correlation_p_value(z / F.sqrt(z * z + many), F.lit(many + 2)))


def correlations(df: DataFrame, columns, target: str, method: str = "pearson") -> DataFrame:
    """Coefficient (3 digits) and p-value (5 digits) of each column with the target.

    All rows with a known target enter; a report on the top rows selects them first.
    """
    rows = df.where(F.col(target) != -1)
    if method == "kendall":
        table = kendall(rows, columns, target)
        return table.select(
            "metric", F.round("coefficient", 3).alias("coefficient"),
            F.round(_kendall_p_value("coefficient", "n"), 5).alias("p_value"),
        )
    if method == "spearman":
        rows = _ranked(rows, columns, target)
    elif method != "pearson":
        raise ValueError(f"unknown correlation {method!r}")
    both = lambda c: F.col(c).isNotNull() & F.col(target).isNotNull()
    wide = rows.agg(*[x for c in columns for x in (F.corr(c, target).alias(f"r_{c}"), F.count_if(both(c)).alias(f"n_{c}"))])
    entries = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"r_{c}").alias("r"), F.col(f"n_{c}").alias("n")) for c in columns
    ])
    return wide.select(F.inline(entries)).select(
        "metric", F.round("r", 3).alias("coefficient"), F.round(correlation_p_value("r", "n"), 5).alias("p_value")
    )


def macro_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Macro precision and recall over all classes seen, and accuracy.

    A class without predictions has precision 0, one without true rows recall 0.
    """
    cells = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    classes = (
        cells.select(F.col("t").alias("cls"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("claimed"), hit.alias("hit"))
        .unionByName(
            cells.select(
                F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("actual"),
                F.col("n").alias("claimed"), F.lit(0).cast("bigint").alias("hit"),
            )
        )
        .groupBy("cls")
        .agg(F.sum("actual").alias("actual"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
    )
    rate = lambda base: F.coalesce(F.try_divide(F.col("hit"), F.col(base)), F.lit(0.0))
    return classes.agg(
        F.avg(rate("claimed")).alias("precision"),
        F.avg(rate("actual")).alias("recall"),
        F.try_divide(F.sum("hit"), F.sum("actual")).alias("accuracy"),
    )
