"""Communities of the undirected flow graph by greedy modularity, and label alignment.

All snapshots and all settings (resolution, normalisation) are clustered in the same loop: a
setting is a key like the period. Weights are whole numbers, and gains are compared exactly, so
labels do not depend on partitions or on the order of sums.

A pass moves vertices between communities. In a round, vertices score the communities around them
by joins and sums, and those whose hash falls on the round's side move at once, so that two
neighbours do not swap for ever. A vertex is scored again only if a neighbour moved or its own
move waits for its side, so snapshots at rest cost nothing; when neither is left anywhere, all
vertices are scored once more, since totals changed too, and the pass ends if nobody wants to
move. Communities are then contracted to vertices and the next pass starts, until no pass moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from odflux.graph.degree import undirected_edges
from odflux.graph.rank import NotConverged
from odflux.operators.filters import vertices_of
from odflux.session import Rounds, materialize

UNIT = 1_000_000  # steps of a normalised weight
FINE = 10_000  # steps of a resolution
SETTING = ("resolution", "normalized")


def _symmetric(edges: DataFrame, by) -> DataFrame:
    """Both directions of undirected edges; a self loop stays one row."""
    turned = edges.where(F.col("src") != F.col("dst")).select(
        *by, F.col("dst").alias("src"), F.col("src").alias("dst"), "cnt"
    )
    return edges.select(*by, "src", "dst", "cnt").unionByName(turned)


def _strengths(arcs: DataFrame, by) -> DataFrame:
    """Weighted degree; a self loop counts twice."""
    weight = F.when(F.col("src") == F.col("dst"), 2 * F.col("cnt")).otherwise(F.col("cnt"))
    return arcs.groupBy(*by, F.col("src").alias("name")).agg(F.sum(weight).alias("k"))


def modularity(edges: DataFrame, labels: DataFrame, label: str = "label", resolution: float = 1.0, by=("time",)) -> DataFrame:
    """Quality of a labelling of the undirected graph: sum over communities of
    ``resolution * internal / m - (degree / 2m)^2``. Edges have ``src < dst`` or are
    self loops; unlabelled vertices do not count.
    """
    by = list(by)
    mass = edges.groupBy(*by).agg(F.sum("cnt").cast("double").alias("m"))
    side = lambda end: labels.select(*by, F.col("name").alias(end), F.col(label).alias(f"_{end}"))
    inside = (
        edges.join(side("src"), [*by, "src"]).join(side("dst"), [*by, "dst"])
        .where(F.col("_src") == F.col("_dst"))
        .groupBy(*by, F.col("_src").alias("c")).agg(F.sum("cnt").cast("double").alias("internal"))
    )
    degree = (
        _strengths(_symmetric(edges, by), by)
        .join(labels.select(*by, "name", F.col(label).alias("c")), [*by, "name"])
        .groupBy(*by, "c").agg(F.sum("k").cast("double").alias("k"))
    )
    part = F.lit(float(resolution)) * F.coalesce("internal", F.lit(0.0)) / F.col("m") - F.pow(
        F.col("k") / (2 * F.col("m")), F.lit(2.0)
    )
    return (
        degree.join(inside, [*by, "c"], "left").join(mass, by)
        .groupBy(*by).agg(F.sum(part).alias("modularity"))
    )


def whole_pairs(edges: DataFrame, settings, by, unit: int = 1) -> DataFrame:
    """Undirected edges of every setting with whole weights: ``unit`` times the count, rounded
    down, or with ``normalized`` the share of the source's out-flow in steps of 1 / UNIT."""
    summed = edges.groupBy(*by, "src", "dst").agg(F.floor(F.sum(F.col("cnt") * unit)).cast("long").alias("cnt"))
    found = None
    for normalized in sorted({bool(n) for _, n in settings}):
        weighted = summed
        if normalized:
            out = summed.groupBy(*by, "src").agg(F.sum("cnt").alias("_out"))
            share = F.expr(f"cast(cast(cnt as decimal(38, 0)) * {UNIT} div nullif(_out, 0) as bigint)")
            weighted = summed.join(out, [*by, "src"]).select(*by, "src", "dst", share.alias("cnt"))
        of = F.array(*[F.lit(float(r)) for r, n in settings if bool(n) == normalized])
        pairs = undirected_edges(weighted, by).select(
            *by, F.explode(of).alias("resolution"), F.lit(normalized).alias("normalized"), "src", "dst", "cnt"
        )
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _half(name, turn: int):
    """Whether it is a vertex's turn: its hash falls on one side in one round, on the other in
    the next, and sides are drawn anew every two rounds."""
    side = F.ascii(F.md5(F.concat_ws(":", name, F.lit(str(turn // 2))))) % 2
    return side == turn % 2


def _round(arcs: DataFrame, state: DataFrame, turn: int, sweep: bool) -> DataFrame:
    """State after one round. ``state`` has a row per vertex: snapshot, name, community c, degree
    k, mass m and steps of the resolution, whether it moved, and whether its move waits.

    Gain of joining c, with own share removed: ``resolution * k_in / m - k * tot / (2 m^2)``, here
    times 2 m^2 FINE.
    """
    own = state.select("snap", F.col("name").alias("src"), F.col("c").alias("own"), "k", "m", "steps")
    if not sweep:
        moved = state.where("moved").select("snap", F.col("name").alias("src"))
        woken = arcs.join(moved, ["snap", "src"], "left_semi").select("snap", F.col("dst").alias("src"))
        woken = woken.unionByName(state.where("waits").select("snap", F.col("name").alias("src"))).distinct()
        own = own.join(woken, ["snap", "src"], "left_semi")
    toward = (
        arcs.join(own, ["snap", "src"]).join(state.select("snap", F.col("name").alias("dst"), "c"), ["snap", "dst"])
        .groupBy("snap", F.col("src").alias("name"), "c", "own", "k", "m", "steps").agg(F.sum("cnt").alias("k_in"))
    )
    totals = state.groupBy("snap", "c").agg(F.sum("k").alias("tot"))
    mine = totals.select("snap", F.col("c").alias("own"), F.col("tot").alias("own_tot"))
    big = lambda c: c.cast("decimal(38,0)")
    gain = lambda k_in, free: big(
        big(k_in) * big(F.col("m")) * big(2 * F.col("steps")) - big(F.col("k")) * big(free) * big(F.lit(FINE))
    )
    is_own = F.col("c") == F.col("own")
    free = F.col("tot") - F.when(is_own, F.col("k")).otherwise(F.lit(0))
    best = (
        toward.join(totals, ["snap", "c"]).join(mine, ["snap", "own"])
        .groupBy("snap", "name").agg(
            # Staying is a choice even for a vertex without neighbours in its community.
            F.greatest(
                F.max(F.when(is_own, gain(F.col("k_in"), free))), F.max(gain(F.lit(0), F.col("own_tot") - F.col("k")))
            ).alias("own_gain"),
            # Highest gain, then the smallest label.
            F.min(F.struct((-gain(F.col("k_in"), free)).alias("g"), F.col("c").alias("c"))).alias("best"),
        )
        .where(-F.col("best.g") > F.col("own_gain")).select("snap", "name", F.col("best.c").alias("to"))
    )
    wants, now = F.col("to").isNotNull(), _half(F.col("name"), turn)
    return state.join(best, ["snap", "name"], "left").select(
        "snap", "name", F.when(wants & now, F.col("to")).otherwise(F.col("c")).alias("c"), "k", "m", "steps",
        (wants & now).alias("moved"), (wants & ~now).alias("waits"),
    )


def communities_of(
    edges: DataFrame, settings=((1.0, False),), init: DataFrame | None = None, by=("time",), unit: int = 1,
    max_rounds: int = 400, max_passes: int = 50,
) -> DataFrame:
    """Labels 0, 1, ... per snapshot and setting; 0 is the largest community.

    ``settings`` are pairs (resolution, normalized), which become columns. ``init`` (keys, name,
    label) gives the starting labels, by name. ``NotConverged`` is raised if vertices still move
    after ``max_rounds`` or communities after ``max_passes``. Resolutions count in steps of
    1 / FINE; weights are whole numbers (``whole_pairs``).
    """
    by = [*by, *SETTING]
    spark = edges.sparkSession
    pairs = materialize(whole_pairs(edges, settings, by[:-2], unit), "pairs")
    # A snapshot and setting is one number in the loop.
    steps = F.round(F.col("resolution") * FINE).cast("long").alias("steps")
    snaps = materialize(pairs.groupBy(*by).agg(F.sum("cnt").alias("m")).select(
        F.monotonically_increasing_id().alias("snap"), *by, "m", steps
    ), "snapshots")
    pairs = materialize(pairs.join(snaps, by).select("snap", "src", "dst", "cnt"), "pairs")
    places = materialize(vertices_of(pairs, ["snap"]), "places")

    start = places.withColumn("c", F.col("name"))
    if init is not None:
        known = init.join(snaps, by).select("snap", "name", F.col("label").cast("string").alias("_l"))
        first = known.groupBy("snap", "_l").agg(F.min("name").alias("_c"))
        start = places.join(known.join(first, ["snap", "_l"]), ["snap", "name"], "left").select(
            "snap", "name", F.coalesce("_c", "name").alias("c")
        )
    member = materialize(start, "member")  # place -> community of the current level
    warm = init is not None
    for _ in range(max_passes):
        arcs = _symmetric(pairs, ["snap"])
        nodes = _strengths(arcs, ["snap"]).join(snaps.select("snap", "m", "steps"), "snap")
        arcs = materialize(arcs.where(F.col("src") != F.col("dst")), "arcs")
        state = nodes.join(member, ["snap", "name"]) if warm else nodes.withColumn("c", F.col("name"))
        store, moves, sweep = Rounds(spark, "moves"), 0, True
        no = F.lit(False)
        state = store.keep(state.select("snap", "name", "c", "k", "m", "steps", no.alias("moved"), no.alias("waits")))
        for turn in range(max_rounds):
            seen = Observation()
            after = _round(arcs, state, turn, sweep)
            state = store.keep(after.observe(
                seen, F.count_if("moved").alias("moved"), F.count_if(F.col("moved") | F.col("waits")).alias("left")
            ))
            moves += seen.get["moved"]
            if seen.get["left"] == 0 and sweep:
                break
            sweep = seen.get["left"] == 0
        else:
            raise NotConverged(f"vertices still move after {max_rounds} rounds")
        if moves == 0 and not warm:
            break
        state = materialize(state.select("snap", "name", "c"), "state")
        if warm:
            member, warm = state, False
        else:
            step = state.select("snap", F.col("name").alias("c"), F.col("c").alias("_next"))
            member = materialize(
                member.join(step, ["snap", "c"]).select("snap", "name", F.col("_next").alias("c")), "member"
            )
        side = lambda end: state.select("snap", F.col("name").alias(end), F.col("c").alias(f"_{end}"))
        pairs = materialize(
            pairs.join(side("src"), ["snap", "src"]).join(side("dst"), ["snap", "dst"])
            .groupBy("snap", F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst"))
            .agg(F.sum("cnt").alias("cnt")),
            "pairs",
        )
    else:
        raise NotConverged(f"communities still merge after {max_passes} passes")
    return _number(member, ["snap"]).join(snaps, "snap").select(*by, "name", "label")


def communities(
    edges: DataFrame, resolution: float = 1.0, init: DataFrame | None = None, normalize: bool = False,
    by=("time",), **options,
) -> DataFrame:
    """Labels of one setting (see ``communities_of``)."""
    if init is not None:
        init = init.withColumns({"resolution": F.lit(float(resolution)), "normalized": F.lit(bool(normalize))})
    return communities_of(edges, [(resolution, normalize)], init, by, **options).drop(*SETTING)


def _number(member: DataFrame, by) -> DataFrame:
    """Communities numbered by size, then by their smallest member.

    The window orders one row per community, not its members.
    """
    sizes = member.groupBy(*by, "c").agg(F.count("*").alias("size"), F.min("name").alias("first"))
    order = Window.partitionBy(*by).orderBy(F.desc("size"), "first")
    numbered = sizes.select(*by, "c", (F.row_number().over(order) - 1).alias("label"))
    return member.join(numbered, [*by, "c"]).select(*by, "name", "label")


# ---- labels that stay the same over time -------------------------------------

def label_history(clusters: DataFrame) -> DataFrame:
    """How often each place carried each label: (name, label, times)."""
    return clusters.groupBy("name", "label").agg(F.count("*").alias("times"))


def label_overlaps(current: DataFrame, history: DataFrame) -> DataFrame:
    """Members of a current label times their past use of each earlier label."""
    past = history.select("name", F.col("label").alias("earlier"), "times")
    return current.join(past, "name").groupBy("label", "earlier").agg(F.sum("times").alias("overlap"))


def _matched(overlaps: DataFrame) -> DataFrame:
    """One-to-one pairs (label, earlier) by falling overlap; ties by label, then earlier label.

    A pair that is the best of both its labels is the next that a greedy choice would take;
    all such pairs are taken at once, and what they use is removed, until no pair is left.
    """
    rounds, pairs = Rounds(overlaps.sparkSession, "matching"), []
    left = rounds.keep(overlaps.where("earlier >= 0"))
    while not left.isEmpty():
        rank = F.struct((-F.col("overlap")).alias("o"), "label", "earlier")
        mine = left.groupBy("label").agg(F.min(rank).alias("b")).select("b.label", "b.earlier")
        theirs = left.groupBy("earlier").agg(F.min(rank).alias("b")).select("b.label", "b.earlier")
        took = materialize(mine.join(theirs, ["label", "earlier"]), "matched")
        pairs.append(took)
        left = rounds.keep(left.join(took.select("label"), "label", "left_anti").join(took.select("earlier"), "earlier", "left_anti"))
    found = overlaps.select("label", "earlier").limit(0)
    for took in pairs:
        found = found.union(took.select("label", "earlier"))
    return found


def align_step(current: DataFrame, history: DataFrame) -> DataFrame:
    """Current clusters renamed to the earlier labels they share most members with; a label
    without a match gets the smallest label left.

    The tables that are ranked have a row per label.
    """
    labels = materialize(current.select("label").distinct(), "labels")
    found = _matched(materialize(label_overlaps(current, history).select("label", "earlier", "overlap"), "overlaps"))
    number = F.row_number().over(Window.orderBy("label"))
    new = labels.join(found, "label", "left_anti").withColumn("k", number)
    # One number more than all labels together is always enough.
    last = labels.agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n").cast("int") * 2)).alias("label"))
    free = last.join(found.select(F.col("earlier").alias("label")), "label", "left_anti").withColumn("k", number)
    named = new.join(free.withColumnRenamed("label", "aligned"), "k").select("label", "aligned")
    mapping = found.select("label", F.col("earlier").alias("aligned")).unionByName(named)
    return current.join(mapping, "label").withColumn("label", F.col("aligned").cast("int")).drop("aligned")


def align_labels(clusters: DataFrame, order) -> DataFrame:
    """Relabel a sequence of clusterings so that labels persist.

    ``clusters`` has (part, name, label); ``order`` lists the parts from first to last
    (a part is a period, or a period and resolution). The first part is the anchor.
    """
    history, done = None, []
    for part in order:
        now = clusters.where(F.col("part") == part).select("part", "name", F.col("label").cast("int").alias("label"))
        if history is not None:
            now = align_step(now, history)
        now = materialize(now.select("part", "name", "label"), "aligned")
        done.append(now)
        used = label_history(now)
        if history is not None:
            used = history.unionByName(used).groupBy("name", "label").agg(F.sum("times").alias("times"))
        history = materialize(used, "history")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result
