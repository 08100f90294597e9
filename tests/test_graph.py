import numpy as np
import pytest
from pyspark.sql import functions as F

from odflux.graph import community, degree, paths, rank, tables
from odflux.session import bucketed, materialize

FIVE = [("a", "b", 2), ("b", "c", 1), ("c", "a", 3), ("a", "c", 1), ("d", "a", 1), ("c", "e", 2)]


def matrix(rows):
    names = sorted({n for a, b, _ in rows for n in (a, b)})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, w in rows:
        m[at[a], at[b]] += w
    return names, m


def as_dict(df, column):
    return {r["name"]: r[column] for r in df.collect()}


def numpy_pagerank(rows, rounds):
    names, m = matrix(rows)
    n, out = len(names), m.sum(axis=1)
    p = np.divide(m, out[:, None], out=np.zeros_like(m), where=out[:, None] > 0)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        x = 0.15 / n + 0.85 * (x @ p + x[out == 0].sum() / n)
    return dict(zip(names, x))


def test_pagerank_with_dangling_vertex(edges_of):
    got = as_dict(rank.pagerank(edges_of(FIVE), rounds=7), "pr")
    assert got == pytest.approx(numpy_pagerank(FIVE, 7), abs=1e-12)
    turned = [(b, a, w) for a, b, w in FIVE]
    got = as_dict(rank.pagerank(edges_of(FIVE), rounds=4, inverse=True), "pr")
    assert got == pytest.approx(numpy_pagerank(turned, 4), abs=1e-12)


def test_pagerank_stops_at_tolerance_and_sums_to_one(edges_of):
    got = as_dict(rank.pagerank(edges_of(FIVE)), "pr")
    assert sum(got.values()) == pytest.approx(1.0)
    assert got == pytest.approx(numpy_pagerank(FIVE, 300), abs=1e-5)


def test_pagerank_ignores_row_normalisation(edges_of):
    raw = edges_of(FIVE)
    assert as_dict(rank.pagerank(degree.normalize_out(raw), rounds=5), "pr") == pytest.approx(
        as_dict(rank.pagerank(raw, rounds=5), "pr")
    )


def test_snapshots_do_not_mix(edges_of):
    both = edges_of(FIVE, "one").unionByName(edges_of(FIVE[:4], "two"))
    got = rank.pagerank(both, rounds=5)
    assert as_dict(got.where("time = 'two'"), "pr") == pytest.approx(numpy_pagerank(FIVE[:4], 5))


def test_hits_against_singular_vectors(edges_of):
    rows = [("a", "b", 5), ("a", "c", 3), ("b", "c", 4), ("c", "a", 1), ("d", "b", 2), ("d", "c", 2)]
    names, m = matrix(rows)
    u, _, vt = np.linalg.svd(m)
    hubs, auths = np.abs(u[:, 0]), np.abs(vt[0])
    got = rank.hits(edges_of(rows))
    assert as_dict(got, "hub") == pytest.approx(dict(zip(names, hubs / hubs.sum())), abs=1e-6)
    assert as_dict(got, "authority") == pytest.approx(dict(zip(names, auths / auths.sum())), abs=1e-6)


def test_closeness_and_betweenness_on_a_path(edges_of):
    path = edges_of([("a", "b", 1), ("b", "c", 1), ("c", "d", 9)])
    close = as_dict(paths.closeness(path), "closeness")
    # d is reached by three others at distances 1, 2, 3.
    assert close == pytest.approx({"a": 0.0, "b": 1 / 3, "c": 2 / 3 * 2 / 3, "d": 3 / 6})
    between = as_dict(paths.betweenness(path), "betweenness")
    assert between == pytest.approx({"a": 0.0, "b": 2 / 6, "c": 2 / 6, "d": 0.0})


def test_path_queries_read_all_edges(spark, edges_of, monkeypatch):
    from odflux.catalog import QUERIES
    from odflux.catalog.inputs import Tables

    rng = np.random.default_rng(11)
    rows = sorted({(f"p{a}", f"p{b}") for a, b in rng.integers(0, 12, (30, 2)) if a != b})
    rows = [(a, b, int(rng.integers(1, 15))) for a, b in rows]
    monkeypatch.setattr(Tables, "edges", lambda self: edges_of(rows))
    names, m = matrix(rows)
    n = len(names)
    dist, count = np.full((n, n), np.inf), np.eye(n)
    np.fill_diagonal(dist, 0)
    walks = np.eye(n)
    for d in range(1, n):
        walks = walks @ (m > 0)
        new = (walks > 0) & np.isinf(dist)
        dist[new], count[new] = d, walks[new]
    reach = np.isfinite(dist)
    far, r = np.where(reach, dist, 0).sum(axis=0), reach.sum(axis=0)
    close = {x: (r[k] - 1) ** 2 / far[k] / (n - 1) if far[k] else 0.0 for k, x in enumerate(names)}
    got = as_dict(QUERIES["grf07_closeness"](spark, "none"), "closeness")
    assert got == pytest.approx(close, abs=1e-6)
    between = {x: sum(
        count[s, k] * count[k, t] / count[s, t] for s in range(n) for t in range(n)
        if len({s, t, k}) == 3 and reach[s, t] and dist[s, k] + dist[k, t] == dist[s, t]
    ) / ((n - 1) * (n - 2)) for k, x in enumerate(names)}
    got = as_dict(QUERIES["grf08_betweenness"](spark, "none"), "betweenness")
    assert got == pytest.approx(between, abs=1e-6)


def test_batches_of_sources_add_up(spark, edges_of):
    from pathlib import Path

    from odflux.session import shared_dir

    rng = np.random.default_rng(4)
    rows = [(f"p{a}", f"p{b}", 1) for a, b in rng.integers(0, 14, (45, 2))]
    edges = edges_of(rows, "x").unionByName(edges_of(rows[:20], "y"))
    key = lambda df, v: {(r["time"], r["name"]): r[v] for r in df.collect()}
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = len(list(folder.glob("level-*")))
    for measure, name in ((paths.closeness, "closeness"), (paths.betweenness, "betweenness")):
        many = measure(edges, pairs=60)  # about six batches
        assert key(many, name) == pytest.approx(key(measure(edges), name))
    # Pairs of a batch are gone when the next one starts.
    assert len(list(folder.glob("level-*"))) == before


def test_path_measures_of_no_edges(edges_of):
    assert paths.closeness(edges_of([])).isEmpty() and paths.betweenness(edges_of([])).isEmpty()


def test_betweenness_shares_equal_paths(edges_of):
    square = edges_of([("s", "x", 1), ("s", "y", 1), ("x", "t", 1), ("y", "t", 1)])
    assert as_dict(paths.betweenness(square, normalized=False), "betweenness") == pytest.approx(
        {"s": 0.0, "x": 0.5, "y": 0.5, "t": 0.0}
    )


def cliques():
    rows = [(a, b, 5) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1:]]
    return rows + [("d", "w", 1)]


def test_communities_find_two_cliques(edges_of):
    edges = edges_of(cliques())
    labels = as_dict(community.communities(edges), "label")
    assert {frozenset(n for n in labels if labels[n] == c) for c in set(labels.values())} == {
        frozenset("abcd"), frozenset("wxyz")
    }


def test_larger_resolution_gives_larger_communities(edges_of):
    edges = edges_of(cliques())
    count = lambda r: community.communities(edges, resolution=r).select("label").distinct().count()
    assert count(0.05) > count(1.0) >= count(30.0)


def test_communities_beat_single_vertices(spark):
    rng = np.random.default_rng(5)
    rows = [("t", f"n{a}", f"n{b}", int(w)) for a, b, w in rng.integers(0, 20, (120, 3)) if a != b and w]
    edges = spark.createDataFrame(rows, "time string, src string, dst string, cnt long")
    pairs = materialize(degree.undirected_edges(edges))
    quality = lambda labels: community.modularity(pairs, labels).first()["modularity"]
    found = community.communities(edges)
    single = found.select("time", "name", F.col("name").alias("label"))
    assert quality(found) > quality(single)


def test_warm_start_keeps_good_labels(edges_of):
    edges = edges_of(cliques())
    first = community.communities(edges)
    again = community.communities(edges, init=first)
    assert as_dict(again, "label") == as_dict(first, "label")


def test_modularity_by_hand(edges_of):
    pairs = edges_of([("a", "b", 1), ("c", "d", 1)])
    labels = pairs.sparkSession.createDataFrame(
        [("t", "a", 0), ("t", "b", 0), ("t", "c", 1), ("t", "d", 1)], "time string, name string, label int"
    )
    assert community.modularity(pairs, labels).first()["modularity"] == pytest.approx(0.5)


def test_alignment_is_greedy_and_one_to_one(spark):
    history = spark.createDataFrame(
        [("a", 7, 3), ("b", 7, 3), ("c", 7, 3), ("d", 2, 3), ("e", 2, 1)], "name string, label int, times long"
    )
    now = spark.createDataFrame(
        [("t", "a", 0), ("t", "b", 0), ("t", "c", 1), ("t", "d", 1), ("t", "e", 1), ("t", "f", 2)],
        "part string, name string, label int",
    )
    got = {r["name"]: r["label"] for r in community.align_step(now, history).collect()}
    # 0 takes 7 (overlap 6), 1 takes 2 (overlap 4), 2 has no past and gets the smallest free label.
    assert got == {"a": 7, "b": 7, "c": 2, "d": 2, "e": 2, "f": 0}


def test_isolated_located_place_has_zero_degrees(spark, edges_of):
    edges = edges_of([("a", "b", 4), ("a", "far", 2), ("c", "far", 1)])
    where = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    table = tables.centrality_table(edges, where, rounds=3, hits_rounds=2)
    rows = {r["name"]: r for r in table.collect()}
    assert (rows["c"]["flow_in"], rows["c"]["flow_out"], rows["c"]["pr"]) == (0, 0, 0.0)
    assert rows["c"]["gross_flow"] == 1.0
    assert rows["a"]["flow_out"] == 4
    assert rows["far"]["pr"] == 0.0 if "far" in rows else True


def test_self_edges_in_gross_and_net_flow(edges_of):
    edges = edges_of([("a", "a", 3), ("a", "b", 1), ("b", "b", 4)])
    assert as_dict(degree.gross_flow(edges), "gross_flow") == {"a": 0.25, "b": 0.0}
    net = as_dict(degree.net_inflow_per_mille(edges), "flow_in_net_country_norm")
    assert net == pytest.approx({"a": -125.0, "b": 125.0})


def test_edge_colors(spark, edges_of):
    labels = spark.createDataFrame([("t", "a", 1), ("t", "b", 1), ("t", "c", 2)], "time string, name string, label int")
    colored = degree.edge_colors(edges_of([("a", "b", 1), ("a", "c", 1), ("a", "x", 1)]), labels)
    assert {r["dst"]: r["color"] for r in colored.collect()} == {"b": 1, "c": -1, "x": -1}


def test_labels_do_not_depend_on_partitions_and_settings_are_keys(spark):
    rng = np.random.default_rng(8)
    rows = [
        (f"t{t}", f"n{a}", f"n{b}", int(w))
        for t in range(3) for a, b, w in rng.integers(0, 24, (150, 3)) if a != b and w
    ]
    edges = spark.createDataFrame(rows, "time string, src string, dst string, cnt long")
    settings = ((0.5, False), (1.0, False), (0.8, True))
    found = {}
    for n in (1, 5):
        labels = community.communities_of(edges.repartition(n), settings).collect()
        found[n] = {(r.time, r.name, r.resolution, r.normalized): r.label for r in labels}
    assert found[1] == found[5] and len(found[1]) == 3 * len({k[:2] for k in found[1]})
    alone = community.communities(edges.where("time = 't1'"), resolution=0.8, normalize=True)
    assert {(r.time, r.name, 0.8, True): r.label for r in alone.collect()} == {
        k: v for k, v in found[1].items() if k[0] == "t1" and k[3]
    }


def test_a_round_moves_only_what_gains(spark):
    edges = spark.createDataFrame(
        [("t", "a", "b", 5), ("t", "b", "c", 5), ("t", "c", "a", 5), ("t", "c", "d", 1), ("t", "d", "e", 4)],
        "time string, src string, dst string, cnt long",
    )
    labels = as_dict(community.communities(edges), "label")
    assert {frozenset(n for n in labels if labels[n] == c) for c in set(labels.values())} == {frozenset("abc"), frozenset("de")}
    # Counts far beyond the exact range of doubles give the same labels.
    huge = edges.withColumn("cnt", F.col("cnt") * 10**14)
    assert as_dict(community.communities(huge), "label") == labels


def test_loop_that_does_not_end_is_an_error(edges_of):
    with pytest.raises(rank.NotConverged):
        community.communities(edges_of(cliques()), max_rounds=1)


def _moves_scan(plan: str, table: str) -> list[bool]:
    """For each scan of the table in a plan: whether an exchange lies between it and its join."""
    lines, found = plan.splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-|*"))
    for at, line in enumerate(lines):
        if table not in line or "Scan" not in line:
            continue
        level, moved = depth(line), False
        for above in reversed(lines[:at]):
            if depth(above) < level:
                level = depth(above)
                if "Join" in above:
                    break
                moved |= "Exchange" in above
        found.append(moved)
    return found


def test_rounds_of_the_ranks_do_not_move_edges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(500).selectExpr("'t' as time", "cast(id % 37 as string) as src", "cast(id % 41 as string) as dst", "1.0D as w")
        links, copy = (bucketed(rows, ["time", end], "edges") for end in ("src", "dst"))
        state = materialize(rows.select("time", F.col("src").alias("name")).distinct().withColumn("pr", F.lit(1.0)))
        for _ in range(2):
            state = rank._inflow(links, state, ["time"], 0.85).groupBy("time", "name").agg(F.sum("pr").alias("pr"))
        plan = state._jdf.queryExecution().executedPlan().toString()
        assert _moves_scan(plan, "odflux_edges") == [False, False]
        # Beside the first state, only the sums of a round move.
        assert plan.count("Exchange") == 3
        hub = materialize(state.select("time", "name", F.col("pr").alias("hub")))
        auth = rank._across(links, hub, ["time"], "src", "dst", "hub", "authority")
        plan = rank._across(copy, auth, ["time"], "dst", "src", "authority", "hub")._jdf.queryExecution().executedPlan().toString()
        assert _moves_scan(plan, "odflux_edges") == [False, False] and plan.count("Exchange") == 3
        moved = materialize(links).join(state.select("time", F.col("name").alias("src")), ["time", "src"])
        plan = moved._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_large_scratch_tables_are_bucketed(spark):
    assert bucketed(spark.range(5), ["id"], "small").count() == 5
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert bucketed(spark.range(5), ["id"], "large").count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    names = [t.name for t in spark.catalog.listTables()]
    assert [n for n in names if n.startswith("odflux_large")] and not [n for n in names if n.startswith("odflux_small")]
