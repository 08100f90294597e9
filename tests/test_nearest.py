import numpy as np
import pandas as pd

from odflux.operators.nearest import nearest_place


def brute(points, places):
    rows = []
    for x, y in points:
        rows.append(min(((float((px - x) * (px - x) + (py - y) * (py - y)), name) for name, px, py in places)))
    return rows


def ask(spark, points, places, leaf):
    p = spark.createDataFrame(pd.DataFrame({"id": range(len(points)), "x": [a for a, _ in points], "y": [b for _, b in points]}))
    q = spark.createDataFrame(places, "name string, px double, py double")
    got = nearest_place(p, q, ("x", "y"), ("px", "py"), ["name"], leaf).collect()
    return {r["id"]: (r["d2"], r["name"]) for r in got}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    # A dense spot, a wide field, and whole-number places with ties and repeats.
    spots = np.concatenate([rng.normal(5, 1e-3, (150, 2)), rng.uniform(-50, 50, (60, 2)), rng.integers(-3, 3, (40, 2))])
    places = [(f"P{k:03d}", float(a), float(b)) for k, (a, b) in enumerate(spots)]
    asked = np.concatenate([rng.normal(5, 1e-2, (40, 2)), rng.uniform(-90, 90, (40, 2)), rng.integers(-4, 4, (40, 2)).astype(float)])
    points = [(float(a), float(b)) for a, b in asked]
    got = ask(spark, points, places, 8)
    assert [got[k] for k in range(len(points))] == brute(points, places)


def test_all_places_at_one_position_and_rows_without_coordinates(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 0.0, 0.0), (4, float("nan"), 1.0), (5, float("inf"), 1.0)], "id int, x double, y double")
    places = spark.createDataFrame([("b", 3.0, 4.0), ("a", 3.0, 4.0), ("0", None, 4.0), ("1", float("-inf"), 0.0)], "name string, px double, py double")
    got = {r["id"]: (r["name"], r["d2"]) for r in nearest_place(points, places, ("x", "y"), ("px", "py"), ["name"]).collect()}
    assert got == {1: ("a", 25.0), 2: (None, None), 3: ("a", 25.0), 4: (None, None), 5: (None, None)}
    empty = nearest_place(points, places.where("px = 9"), ("x", "y"), ("px", "py"), ["name"])
    assert empty.columns == ["id", "x", "y", "name", "px", "py", "d2"]
    assert {(r["name"], r["d2"]) for r in empty.collect()} == {(None, None)}
    assert nearest_place(points.limit(0), places, ("x", "y"), ("px", "py"), ["name"]).count() == 0
