"""Scalar expressions on text, points and numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bounds of symbol size classes by metric.
SIZE_BOUNDS = {
    "pr": [0.001, 0.002, 0.0035, 0.005, 0.01, 0.015, 0.02, 0.03, 1.0],
    "authority": [0.001, 0.002, 0.0035, 0.005, 0.01, 0.015, 0.02, 0.03, 1.0],
    "hub": [0.001, 0.003, 0.005, 0.007, 0.009, 0.011, 0.013, 0.015, 0.02, 1.0],
}
# Smallest displayed total demand, ratio limit, topic weight limit.
DEMAND_FLOOR = 30000
RATIO_LIMIT = 0.5
TOPIC_WEIGHT_LIMIT = 0.1


def _col(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


# ---- text -------------------------------------------------------------------

def contains_any(column, words) -> Column:
    return reduce(lambda a, b: a | b, [_col(column).contains(w) for w in words])


def contains_position(column, word: str) -> Column:
    """Zero-based position of a word, -1 when it is missing."""
    return F.instr(_col(column), word) - 1


def find_keywords(column, words) -> Column:
    """Indexes of the words that occur in a text."""
    hits = [F.when(_col(column).contains(w), F.lit(i)) for i, w in enumerate(words)]
    return F.array_compact(F.array(*hits))


def join_query_title(query, title) -> Column:
    """``query;;title`` with commas blanked; a missing title counts as empty."""
    joined = F.concat(_col(query), F.lit(";;"), F.coalesce(_col(title), F.lit("")))
    return F.translate(joined, ",", " ")


def point_part(column, index: int) -> Column:
    pattern = r"^\(\s*([^,\s]+)\s*,\s*([^,\s]+)\s*\)$"
    return F.regexp_extract(_col(column), pattern, index).try_cast("double")


def parse_point(column) -> Column:
    """``(x, y)`` text to a struct of doubles; unparsable parts are null."""
    return F.struct(point_part(column, 1).alias("x"), point_part(column, 2).alias("y"))


def append_suffix(column, suffix: str) -> Column:
    return F.concat(_col(column), F.lit(suffix))


def is_digit(column) -> Column:
    return _col(column).rlike("^[0-9]+$")


# ---- points -----------------------------------------------------------------

GRID_ROW = 100000  # Fixed value: grid rows are numbered in steps of this size.


def grid_id(x, y, length: int) -> Column:
    """Cell number; coordinates are truncated to integers first and then floored."""
    cell = lambda c: F.floor(_col(c).cast("bigint") / F.lit(length))
    return (cell(x) * F.lit(GRID_ROW) + cell(y)).cast("bigint")


def squared_distance(x0, y0, x1, y1) -> Column:
    dx, dy = _col(x0) - _col(x1), _col(y0) - _col(y1)
    return dx * dx + dy * dy


def euclid(x0, y0, x1, y1) -> Column:
    return F.sqrt(squared_distance(x0, y0, x1, y1))


# ---- numbers ----------------------------------------------------------------

def smoothed_ratio(a, b, eps: float = 1e-9) -> Column:
    return (_col(a) + F.lit(eps)) / (_col(b) + F.lit(eps))


def clamp(column, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(column), F.lit(low)), F.lit(high))


def floor_value(column, minimum: float) -> Column:
    return F.greatest(_col(column), F.lit(minimum))


def bucket_by_bounds(column, bounds) -> Column:
    """Index of the last bound the value exceeds, plus one.

    The lowest class is 1 whether or not the first bound is exceeded, because the
    index starts at zero.
    """
    value = F.greatest(_col(column), F.lit(0.0))
    exceeded = reduce(lambda a, b: a + b, [(value > F.lit(b)).cast("int") for b in bounds])
    return F.greatest(exceeded, F.lit(1))


def growth(now, base) -> Column:
    """(now - base) / base, null when the base is 0 or missing."""
    return F.try_divide(_col(now) - _col(base), _col(base))


def guarded_growth(now, base, threshold: float, total) -> Column:
    """Growth where the base exceeds ``threshold * total``, else 0."""
    enough = _col(base) > F.lit(threshold) * _col(total)
    return F.when(enough, F.coalesce(growth(now, base), F.lit(0.0))).otherwise(F.lit(0.0))


def guarded_salary_growth(now, base, minimum: float = 100.0) -> Column:
    """Change over the absolute base where the base is large enough, else 0."""
    base = _col(base)
    change = F.try_divide(_col(now) - base, F.abs(base))
    return F.when(F.abs(base) > F.lit(minimum), change).otherwise(F.lit(0.0))


def seasonally_adjusted_change(now, base, trend_now, trend_base, threshold: float, total) -> Column:
    """now / base scaled by the trend of a reference pair of periods, minus 1."""
    trend_base = _col(trend_base)
    trend = F.when(trend_base > 0, _col(trend_now) / trend_base).otherwise(F.lit(0.0))
    change = F.try_divide(_col(now), _col(base)) * trend - F.lit(1.0)
    enough = _col(base) > F.lit(threshold) * _col(total)
    return F.when(enough, F.coalesce(change, F.lit(0.0))).otherwise(F.lit(0.0))
