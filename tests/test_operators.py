import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from odflux.functions import periods, scalars
from odflux.operators import aggregates, filters, joins, ranking, setops, stats, text
from odflux.plans import maps
from odflux.sources import files


def test_average_rank_like_pandas_on_skewed_scores(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({
        "g": rng.choice(["hot", "b", "c"], 3000, p=[0.8, 0.15, 0.05]),
        "s": np.round(rng.pareto(0.5, 3000), 2),
        "id": range(3000),
    })
    got = ranking.average_rank_desc(spark.createDataFrame(frame), ["g"], "s").toPandas().set_index("id").sort_index()
    expected = frame.groupby("g")["s"].rank(method="average", ascending=False)
    assert np.array_equal(got["rank"].to_numpy(), expected.to_numpy())


def test_rows_without_score_get_no_rank(spark):
    rows = spark.createDataFrame([("g", 1.0), ("g", None)], "g string, s double")
    assert {r["s"]: r["rank"] for r in ranking.average_rank_desc(rows, ["g"], "s").collect()} == {1.0: 1.0, None: None}


def test_quantiles_like_numpy(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=501).tolist() + [1e6, -1e6, 0.0, 0.0]
    points = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = ranking.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", points).first()
    assert [got[f"q_{p}"] for p in points] == pytest.approx(np.quantile(values, points).tolist())


def test_kendall_with_ties_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 6, 60).astype(float), rng.integers(0, 9, 60).astype(float)
    sx = np.sign(x[:, None] - x[None, :])
    sy = np.sign(y[:, None] - y[None, :])
    expected = (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert stats.kendall(rows, ["x"], "y").first()["coefficient"] == pytest.approx(expected)


def _tau(x, y):
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())


@pytest.mark.parametrize("chunk", [1, 7, 50])
def test_kendall_over_chunks_with_heavy_values(spark, chunk):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"a": rng.integers(0, 40, 400), "b": rng.normal(size=400), "y": rng.integers(0, 60, 400)}).astype(float)
    frame.loc[:150, "a"] = 20.0  # a third of all rows share x, others y, and some both
    frame.loc[100:280, "y"] = 30.0
    frame["b"] += frame["y"] / 30
    frame["same"] = 1.0
    got = {r["metric"]: r for r in stats.kendall(spark.createDataFrame(frame), ["a", "b", "same"], "y", chunk).collect()}
    for c in ("a", "b"):
        assert got[c]["n"] == 400 and got[c]["coefficient"] == pytest.approx(_tau(frame[c].to_numpy(), frame["y"].to_numpy()))
    assert got["same"]["coefficient"] is None


def test_weighted_inversions_beyond_64_bits():
    value, weight = np.array([5, 3, 9, 3, 1]), np.array([2, 1, 7, 4, 3])
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5) if value[i] > value[j]]
    assert stats._inversions(value, weight) == sum(int(weight[i] * weight[j]) for i, j in pairs)
    big = weight.astype(np.int64) << 40
    assert stats._inversions(value, big) == sum(int(weight[i]) * int(weight[j]) for i, j in pairs) << 80


def test_kendall_takes_all_rows(spark):
    rows = spark.range(2000).selectExpr("cast(id as double) as x", "cast(id % 7 as double) as y")
    got = stats.kendall(rows, ["x"], "y").first()
    y = np.arange(2000) % 7
    gap = sum(int((y[k + 1 :] > v).sum()) - int((y[k + 1 :] < v).sum()) for k, v in enumerate(y))
    pairs = 2000 * 1999 / 2
    ties = sum(c * (c - 1) / 2 for c in np.bincount(y))
    assert got["n"] == 2000 and got["coefficient"] == pytest.approx(gap / np.sqrt(pairs * (pairs - ties)))


@pytest.mark.parametrize("r, n, p", [(0.5, 12, 0.09785), (-0.3, 50, 0.03428), (0.0, 9, 1.0), (1.0, 9, 0.0), (0.05, 100_000, 0.0)])
def test_p_value_of_a_correlation(spark, r, n, p):
    got = spark.range(1).select(stats.correlation_p_value(F.lit(r), F.lit(n)).alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=2e-5)


def test_heavy_tailed_values_fall_into_even_chunks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK_ROWS", 500)
    values = np.random.default_rng(9).lognormal(0, 3, 20_000)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    bounds = rows.agg(F.percentile_approx("v", [k / 40 for k in range(1, 40)], F.lit(10000)).alias("b")).first()["b"]
    chunk = ranking._chunk_of(F.col("v"), F.array(*map(F.lit, bounds)))
    sizes = [r["count"] for r in rows.groupBy(chunk.alias("c")).count().collect()]
    assert len(sizes) == 40 and max(sizes) <= 0.03 * len(values)
    got = {r["v"]: r["before"] for r in ranking.positions(rows, [], "v").collect()}
    assert all(got[float(v)] == k for k, v in enumerate(np.sort(values)))


def test_correlations_and_p_values(spark):
    rows = spark.createDataFrame([(str(i), float(i), float(i % 3), float(i * i)) for i in range(30)], "name string, g double, a double, b double")
    got = {r["metric"]: r for r in stats.correlations(rows, ["a", "b"], "g", "spearman").collect()}
    assert got["b"]["coefficient"] == 1.0 and got["b"]["p_value"] == 0.0
    assert 0.5 < got["a"]["p_value"] <= 1.0


def test_macro_metrics_with_a_class_never_predicted(spark):
    rows = spark.createDataFrame([("x", "x"), ("x", "y"), ("z", "y"), ("y", "y")], "t string, p string")
    got = stats.macro_metrics(rows, "t", "p").first()
    assert got["precision"] == pytest.approx((1 + 1 / 3 + 0) / 3)
    assert got["recall"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert got["accuracy"] == 0.5


def test_category_sum_keeps_rows_of_the_base_only(spark):
    counts = spark.createDataFrame(
        [("a", "t", 0, 4), ("a", "t", 1, 2), ("b", "t", 1, 6)], "name string, time string, topic int, cnt long"
    )
    got = aggregates.category_sum(counts, {"Base": [0], "Some": [1]}, base="Base").collect()
    assert [(r["name"], r["jd_Base"], r["jd_Some"], r["jd_Some_norm"]) for r in got] == [("a", 4.0, 2.0, 0.25)]


def test_distinct_users_per_day(spark):
    day = dt.date(2020, 1, 5)
    rows = [("u", day, "p", "a", "p", "b")] * 3 + [("v", day, "p", "a", "p", "b"), ("u", dt.date(2020, 1, 6), "p", "a", "p", "b")]
    trips = spark.createDataFrame(rows, "userid string, event_date date, province_from string, city_from string, province_to string, city_to string")
    assert sorted(r["cnt"] for r in aggregates.user_day_od_count(trips).collect()) == [1, 2]


def test_boundary_periods_keep_a_quarter_that_starts_before_the_range(spark):
    rows = spark.createDataFrame([("2019Q3",), ("2019Q4",), ("2020Q1",), ("2020Q2",)], "time string")
    kept = filters.drop_boundary_periods(rows, (2019, 11), (2020, 2), "season")
    assert sorted(r["time"] for r in kept.collect()) == ["2019Q4", "2020Q1"]


def test_period_functions(spark):
    row = spark.range(1).select(
        periods.period_to_date(F.lit("201912")).alias("m"), periods.period_to_date(F.lit("2020Q3")).alias("q"),
        periods.parse_compact_timestamp(F.lit("20200230000000")).alias("bad"),
        periods.season_str(F.lit("2020-12-31").cast("date")).alias("s"),
    ).first()
    assert (row["m"], row["q"], row["bad"], row["s"]) == (dt.date(2019, 12, 1), dt.date(2020, 7, 1), None, "2020Q4")
    months = [r["time"] for r in periods.month_timeline(spark, (2019, 11), (2020, 2)).collect()]
    assert months == ["201911", "201912", "202001", "202002"]


def test_grid_id_truncates_then_floors(spark):
    row = spark.range(1).select(scalars.grid_id(F.lit(-0.5), F.lit(-1.5), 2000).alias("g")).first()
    assert row["g"] == 0 * 100000 - 1


def test_size_classes(spark):
    values = [-1.0, 0.0, 0.001, 0.0015, 0.0025, 0.5, 2.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(
        scalars.bucket_by_bounds("v", scalars.SIZE_BOUNDS["pr"]).alias("c")
    )
    assert [r["c"] for r in got.collect()] == [1, 1, 1, 1, 2, 8, 9]


def test_growth_guards(spark):
    row = spark.range(1).select(
        scalars.growth(F.lit(1.0), F.lit(0.0)).alias("zero"),
        scalars.guarded_growth(F.lit(3.0), F.lit(2.0), 0.1, F.lit(100.0)).alias("small"),
        scalars.guarded_salary_growth(F.lit(-100.0), F.lit(-200.0)).alias("salary"),
        scalars.seasonally_adjusted_change(F.lit(4.0), F.lit(2.0), F.lit(3.0), F.lit(6.0), 0.0, F.lit(1.0)).alias("trend"),
    ).first()
    assert (row["zero"], row["small"], row["salary"], row["trend"]) == (None, 0.0, 0.5, 0.0)


def test_lookup_strict_raises_on_a_missing_key(spark):
    dim = spark.createDataFrame([("a", "A")], "name string, en_name string")
    rows = spark.createDataFrame([("a",), ("b",)], "name string")
    assert joins.lookup_strict(rows.where("name = 'a'"), dim, "name", "en_name").first()["en_name"] == "A"
    with pytest.raises(Exception, match="no en_name for b"):
        joins.lookup_strict(rows, dim, "name", "en_name").collect()


def test_near_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    points = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-50, 50, (60, 2)))]
    got = joins.near_pairs(spark.createDataFrame(points, "name string, mc_x double, mc_y double"), 17.0)
    expected = {(a[0], b[0]) for a in points for b in points if np.hypot(a[1] - b[1], a[2] - b[2]) < 17.0}
    assert {(r["name_a"], r["name_b"]) for r in got.collect()} == expected


def test_missing_target_wage_means_no_difference(spark):
    edges = spark.createDataFrame([("2020Q1", 2020, "a", "b", 1), ("2020Q1", 2020, "b", "a", 1)], "time string, year int, src string, dst string, cnt long")
    wages = spark.createDataFrame([(2020, "a", 5.0)], "year int, name string, wage double")
    got = joins.join_on_year_and_city(edges, wages).collect()
    assert [(r["src"], r["wage_diff"]) for r in got] == [("a", 0.0)]


def test_sentinels_and_carried_years(spark):
    edges = spark.createDataFrame([("t", "a", "NuLL", 1), ("t", "a", "b", 2), ("t", "a", "a", 3)], "time string, src string, dst string, cnt long")
    assert [r["cnt"] for r in files.clean_edges(edges).collect()] == [2]
    assert sorted(r["cnt"] for r in files.clean_edges(edges, self_edge=True).collect()) == [2, 3]
    years = spark.createDataFrame([(2021, 1.0), (2020, 2.0)], "year int, wage double")
    assert sorted((r["year"], r["wage"]) for r in setops.carry_forward_year(years, 2021, 2022).collect()) == [
        (2020, 2.0), (2021, 1.0), (2022, 1.0)
    ]


def test_sparse_to_dense_adds_repeated_indexes(spark):
    row = spark.range(1).select(F.array(F.lit(2), F.lit(0), F.lit(2)).alias("i"), F.array(F.lit(1.0), F.lit(5.0), F.lit(2.0)).alias("v"))
    assert row.select(aggregates.sparse_to_dense("i", "v", 4).alias("d")).first()["d"] == [5.0, 0.0, 3.0, 0.0]


def test_term_vectors(spark):
    docs = spark.createDataFrame([(1, "ab ab cd 12"), (2, "cd zz"), (3, None)], "id long, t string")
    vocabulary = text.word_count(docs, "t", min_count=1)
    assert {(r["word"], r["cnt"]) for r in vocabulary.collect()} == {("ab", 2), ("cd", 2)}
    tf = {(r["id"], r["word"]): r["tf"] for r in text.tf_vector(docs, "id", "t", vocabulary).collect()}
    assert tf == pytest.approx({(1, "ab"): 2 / 3, (1, "cd"): 1 / 3, (2, "cd"): 1.0})
    raw = {(r["id"], r["word"]): r["tf"] for r in text.tf_vector(docs, "id", "t", vocabulary, norm=False).collect()}
    assert raw == pytest.approx({(1, "ab"): 0.5, (1, "cd"): 0.25, (2, "cd"): 0.5})
    idf = {r["word"]: r["idf"] for r in text.inverse_document_frequency(docs, "t", vocabulary).collect()}
    assert idf == pytest.approx({"ab": np.log(2.0), "cd": 0.0})


def test_demand_floor_shows_for_known_places_only(spark, edges_of):
    where = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "name string, ll_x double, ll_y double")
    scores = spark.createDataFrame([("t", "a", 10.0)], "time string, name string, jd_All double")
    none = spark.createDataFrame([], "name string, alias string")
    got = maps.choropleth(edges_of([("a", "b", 1)]), scores, where, none, "t", "jd_All")
    assert {r["name"]: r["value"] for r in got.collect()} == {"a": 30000.0, "b": 0.0}


def test_sample_is_repeatable(spark):
    rows = spark.range(1000)
    once = {r["id"] for r in filters.sample_fraction(rows, 0.2, ["id"]).collect()}
    again = {r["id"] for r in filters.sample_fraction(rows.repartition(7), 0.2, ["id"]).collect()}
    assert once == again and 120 < len(once) < 280
    assert filters.sample_n(rows, 17, ["id"]).count() == 17


def test_intermediate_tables_are_removed(spark):
    from pathlib import Path

    from odflux.session import materialize, remove_scratch, shared_dir

    ranking.quantiles(spark.range(10).selectExpr("cast(id as double) as v"), [], "v", (0.5,)).collect()
    folder = Path(shared_dir(spark).removeprefix("file:"))
    materialize(spark.range(3), "kept-for-the-test")
    assert list(folder.glob("kept-for-the-test-*"))
    remove_scratch(spark)
    assert not list(folder.glob("kept-for-the-test-*")) and not list(folder.glob("bounds-*"))


def test_topic_word_matrix_is_the_mean_of_each_topic(spark):
    weights = spark.createDataFrame(
        [(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0), (3, "b", 1.0), (4, "a", 1.0)], "doc long, word string, tf double"
    )
    topics = spark.createDataFrame([(1, 0), (2, 0), (3, 2), (4, None), (5, 2)], "doc long, topic int")
    vocabulary = spark.createDataFrame([("a", 3), ("b", 2), ("unused", 9)], "word string, cnt long")
    got = {r["word"]: tuple(r)[1:] for r in text.topic_word_matrix(weights, topics, vocabulary, "doc", 3).collect()}
    assert got == {"a": (0.75, 0.0, 0.0), "b": (0.25, 0.0, 0.5), "unused": (0.0, 0.0, 0.0)}
