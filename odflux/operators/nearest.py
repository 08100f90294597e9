"""Nearest place of every point over all places, by descent through a grid that splits dense cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.session import Rounds, materialize

LEAF = 64  # different positions of a cell that is not split further
DEPTH = 30  # halvings of the side of the whole area

_BOX = ("_x0", "_x1", "_y0", "_y1")


def _grid(places: DataFrame, leaf: int) -> tuple[list[DataFrame], DataFrame]:
    """Cells by depth, each with the box of its places, and places with the cell they end in.

    ``places`` has a row per position (_px, _py). Depth by depth, only the places of cells with
    more than ``leaf`` positions are read again, so a dense spot makes a deep branch and does not
    refine the rest.
    """
    span = places.agg(F.min("_px"), F.max("_px"), F.min("_py"), F.max("_py")).first()
    if span[0] is None:
        return [], places
    side = (max(span[1] - span[0], span[3] - span[2]) or 1.0) * (1 + 1e-6)
    levels, ends, left = [], [], places
    for depth in range(1, DEPTH + 1):
        cell = lambda c, low: F.floor((F.col(c) - F.lit(low)) / F.lit(side) * F.lit(2.0**depth)).cast("long")  # noqa: B023, E731
        left = left.withColumns({"_cx": cell("_px", span[0]), "_cy": cell("_py", span[2])})
        cells = left.groupBy("_cx", "_cy").agg(
            F.min("_px").alias("_x0"), F.max("_px").alias("_x1"), F.min("_py").alias("_y0"), F.max("_py").alias("_y1"),
            ((F.count("*") <= leaf) | F.lit(depth == DEPTH)).alias("_end"),
        )
        cells = materialize(cells, "cells")
        levels.append(cells.select(F.lit(depth).alias("_depth"), "*"))
        marked = left.join(cells.select("_cx", "_cy", "_end"), ["_cx", "_cy"])
        marked = materialize(marked.withColumn("_depth", F.lit(depth)), "places")
        ends.append(marked.where("_end").drop("_end"))
        if cells.where(~F.col("_end")).isEmpty():
            break
        left = marked.where(~F.col("_end")).drop("_end", "_depth")
    found = ends[0]
    for part in ends[1:]:
        found = found.unionByName(part)
    return levels, found


def _bounds(x, y):
    """Squared distances from a point to the nearest and farthest spot of a box. Rounding keeps
    the order of distances, so no place of the box lies outside them."""
    outside = lambda v, lo, hi: F.greatest(F.col(lo) - v, v - F.col(hi), F.lit(0.0))
    across = lambda v, lo, hi: F.greatest(F.abs(F.col(lo) - v), F.abs(F.col(hi) - v))
    squares = lambda f: f(x, "_x0", "_x1") * f(x, "_x0", "_x1") + f(y, "_y0", "_y1") * f(y, "_y0", "_y1")
    return squares(outside), squares(across)


def nearest_place(
    points: DataFrame, places: DataFrame, point: tuple[str, str], place: tuple[str, str], ties, leaf: int = LEAF
) -> DataFrame:
    """Each row of ``points`` with the columns of its nearest place and ``d2``, the squared distance.

    Every round a position meets the children of its cells by an equi join; a cell goes if its
    nearest spot is farther than the farthest spot of another one. Only the places of the cells
    left at the end are compared, so no position meets all places, and one cell holding all
    places is split like any other. Cells near the top are few rows, whose size Spark knows;
    points at one position are one row until the end.

    Equal distances go to the smallest ``ties`` (columns of places), as do places at one position.
    Points without finite coordinates, and all points if no place has any, get nulls. Places
    without finite coordinates are never found. The two tables share no column name.
    """
    ties, (x, y), (px, py) = list(ties), point, place
    fine = lambda c: F.abs(F.col(c).cast("double")) < float("inf")  # noqa: E731  (NaN is the largest number)
    values = [c for c in places.columns if c not in ties]
    whole = F.struct(*[F.col(c) for c in (*ties, *values)])
    spots = places.where(fine(px) & fine(py)).groupBy(
        F.col(px).cast("double").alias("_px"), F.col(py).cast("double").alias("_py")
    ).agg(F.min(whole).alias("_place"))
    spots = materialize(spots, "spots")
    levels, placed = _grid(spots, leaf)
    key = points.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    if not levels:
        nothing = [F.lit(None).cast(places.schema[c].dataType).alias(c) for c in places.columns]
        return points.select("*", *nothing, F.lit(None).cast("double").alias("d2"))
    asked = key.where(fine("_x") & fine("_y")).select("_x", "_y").distinct()

    store, cell = Rounds(points.sparkSession, "frontier"), F.lit(0).cast("long")
    frontier = asked.select(
        "_x", "_y", F.lit(0).alias("_depth"), cell.alias("_cx"), cell.alias("_cy"), F.lit(False).alias("_end"),
        F.lit(0.0).alias("_near"), F.lit(float("inf")).alias("_far"),
    )
    of_point = Window.partitionBy("_x", "_y")  # the cells left of one position
    for cells in levels:
        near, far = _bounds(F.col("_x"), F.col("_y"))
        parents = frontier.where(~F.col("_end")).select("_x", "_y", F.col("_cx").alias("_ax"), F.col("_cy").alias("_ay"))
        children = cells.withColumns({"_ax": F.shiftright("_cx", 1), "_ay": F.shiftright("_cy", 1)})
        entered = parents.join(children, ["_ax", "_ay"]).select(
            "_x", "_y", "_depth", "_cx", "_cy", "_end", near.alias("_near"), far.alias("_far")
        )
        both = frontier.where("_end").unionByName(entered)
        both = both.withColumn("_least", F.min("_far").over(of_point)).where("_near <= _least").drop("_least")
        frontier = store.keep(both)

    dx, dy = F.col("_px") - F.col("_x"), F.col("_py") - F.col("_y")
    best = (
        frontier.select("_x", "_y", "_depth", "_cx", "_cy").join(placed, ["_depth", "_cx", "_cy"])
        .groupBy("_x", "_y").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "_place")).alias("_best"))
    )
    found = [F.col(f"_best._place.`{c}`").alias(c) for c in places.columns]
    return key.join(best, ["_x", "_y"], "left").select(*points.columns, *found, F.col("_best.d2").alias("d2"))
