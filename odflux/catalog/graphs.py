"""Flow-graph operators on quarter edges."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from odflux.catalog.inputs import rounded
from odflux.catalog.registry import query
from odflux.catalog.views import hits_views, pagerank_views
from odflux.graph import community, degree, paths, rank, tables
from odflux.operators.filters import vertices_of
from odflux.operators.setops import append
from odflux.session import materialize

PR_ROUNDS, HITS_ROUNDS = 8, 4
LOCATED = "located_edges"


def located(t):
    return materialize(degree.build_graph(t.edges(), t.location()), "located")


@query("grf01_build_graph", "select time, src, dst, cnt from located_edges")
def _(t):
    return degree.build_graph(t.edges(), t.location())


@query(
    "grf01_build_graph_normalized",
    "select time, src, dst, round(cnt / sum(cnt) over (partition by time, src), 6) as cnt from located_edges",
)
def _(t):
    return rounded(degree.build_graph(t.edges(), t.location(), normalize=True), 6, "cnt")


@query(
    "grf02_degrees",
    """select time, name, sum(i)::bigint as flow_in, sum(o)::bigint as flow_out, sum(i - o)::bigint as flow_in_net, sum(o - i)::bigint as flow_out_net
       from (select time, dst as name, cnt as i, 0 as o from located_edges union all select time, src, 0, cnt from located_edges
             union all select time, name, 0, 0 from (select distinct time from located_edges) cross join location) group by all""",
)
def _(t):
    graph = located(t)
    every = graph.select("time").distinct()
    # Every place in every period: the list of periods travels with each place.
    periods = every.agg(F.collect_set("time").alias("times"))
    names = t.location().select("name").crossJoin(periods).select(F.explode("times").alias("time"), "name")
    return degree.degrees(graph, names)


@query(
    "grf03_gross_flow",
    """select time, src as name, round(sum(case when src <> dst then cnt else 0 end) / sum(cnt), 6) as gross_flow
       from season_flow group by all""",
)
def _(t):
    return rounded(degree.gross_flow(t.flow()), 6, "gross_flow")


@query(
    "grf04_net_inflow_per_mille",
    """select time, name, round((sum(i) - sum(o)) * 1000 / any_value(total), 6) as flow_in_net_country_norm
       from (select time, dst as name, cnt as i, 0 as o from season_flow union all select time, src, 0, cnt from season_flow)
       join (select time, sum(cnt) as total from season_flow group by all) using (time) group by time, name""",
)
def _(t):
    return rounded(degree.net_inflow_per_mille(t.flow()), 6, "flow_in_net_country_norm")


@query(
    "grf05_pagerank", "select time, name, round(pr, 8) as pr from pr_out", pagerank_views(LOCATED, PR_ROUNDS, "pr_out"),
)
def _(t):
    return rounded(rank.pagerank(located(t), rounds=PR_ROUNDS), 8, "pr")




@query(
    "grf05_pagerank_dangling",
    "select time, name, round(pr, 8) as pr from pr_sparse",
    {"sparse": "select time, src, dst, cnt from season_edges where dst > src", **pagerank_views("sparse", PR_ROUNDS, "pr_sparse", turn=True)},
)
def _(t):
    return rounded(rank.pagerank(t.edges().where("dst > src"), rounds=PR_ROUNDS, inverse=True), 8, "pr")


@query("grf05_pagerank_converged")
def _(t):
    return rank.pagerank(located(t))


@query(
    "grf06_hits",
    "select time, name, round(hub, 8) as hub, round(authority, 8) as authority from hits_raw",
    hits_views(LOCATED, HITS_ROUNDS, "hits_raw"),
)
def _(t):
    return rounded(rank.hits(located(t), rounds=HITS_ROUNDS), 8, "hub", "authority")


@query(
    "grf06_hits_normalized",
    "select time, name, round(hub, 8) as hub, round(authority, 8) as authority from hits_norm",
    {
        "norm_edges": "select time, src, dst, cnt / sum(cnt) over (partition by time, src) as cnt from located_edges",
        **hits_views("norm_edges", HITS_ROUNDS, "hits_norm"),
    },
)
def _(t):
    return rounded(rank.hits(located(t), rounds=HITS_ROUNDS, normalize=True), 8, "hub", "authority")


# So many rounds that doubles hardly change any more; the loops stop by their own rule.
FIXED_PR, FIXED_HITS = 40, 30


@query(
    "grf05_pagerank_fixed_point", "select time, name, round(pr, 8) as pr from pr_fixed", pagerank_views(LOCATED, FIXED_PR, "pr_fixed"),
)
def _(t):
    return rounded(rank.pagerank(located(t), tol=1e-13), 8, "pr")


@query(
    "grf06_hits_fixed_point",
    "select time, name, round(hub, 8) as hub, round(authority, 8) as authority from hits_fixed",
    hits_views(LOCATED, FIXED_HITS, "hits_fixed"),
)
def _(t):
    return rounded(rank.hits(located(t), tol=1e-12), 8, "hub", "authority")


@query("grf06_hits_converged")
def _(t):
    return rank.hits(located(t))


REACH = {
    "link": "select distinct time, src, dst from season_edges where src <> dst",
    "linked": "select time, src as name from season_edges union select time, dst from season_edges",
    "lv0": "select time, name as s, name as v, 0 as d, 1.0::double as sigma from linked",
}
HOPS = 12
for _h in range(1, HOPS + 1):
    REACH[f"lv{_h}"] = f"""
        select p.time, p.s, e.dst as v, {_h} as d, sum(p.sigma) as sigma from lv{_h - 1} p join link e on e.time = p.time and e.src = p.v
        where {' and '.join(f'not exists (select 1 from lv{k} q where q.time = p.time and q.s = p.s and q.v = e.dst)' for k in range(_h))}
        group by all"""
REACH["reach"] = " union all ".join(f"select * from lv{h}" for h in range(HOPS + 1))


CLOSENESS = """select time, name, round(coalesce(case when dist > 0 then (r - 1) / dist * (r - 1) / (n - 1) end, 0), 6) as closeness
       from (select time, v as name, count(*) as r, sum(d) as dist from reach group by all)
       join (select time, count(*) as n from linked group by all) using (time)"""


# Two names of one query: the first once read a part of the edges.
@query("grf07_closeness", CLOSENESS, REACH)
@query("grf07_closeness_all_edges", CLOSENESS, REACH)
def _(t):
    return rounded(paths.closeness(t.edges()), 6, "closeness")


BETWEENNESS = """select time, name, round(coalesce(b, 0) / case when n > 2 then (n - 1) * (n - 2) else 1 end, 6) as betweenness
       from linked join (select time, count(*) as n from linked group by all) using (time)
       left join (select a.time, a.v as name, sum(a.sigma * c.sigma / p.sigma) as b from reach a
                  join reach c on a.time = c.time and a.v = c.s
                  join reach p on p.time = a.time and p.s = a.s and p.v = c.v and p.d = a.d + c.d
                  where a.s <> a.v and a.v <> c.v and a.s <> c.v group by all) using (time, name)"""


@query("grf08_betweenness", BETWEENNESS, REACH)
@query("grf08_betweenness_all_edges", BETWEENNESS, REACH)
def _(t):
    return rounded(paths.betweenness(t.edges()), 6, "betweenness")


@query(
    "grf09_centrality_table",
    """select time, name, coalesce(flow_in, 0) as flow_in, coalesce(flow_out, 0) as flow_out, coalesce(flow_in - flow_out, 0) as flow_in_net,
              coalesce(flow_out - flow_in, 0) as flow_out_net, round(coalesce(o.pr, 0), 8) as pr, round(coalesce(o.pr, 0), 8) as pr_norm,
              round(coalesce(i.pr, 0), 8) as pr_inv, round(coalesce(i.pr, 0), 8) as pr_norm_inv,
              round(coalesce(r.hub, 0), 8) as hub, round(coalesce(r.authority, 0), 8) as authority,
              round(coalesce(m.hub, 0), 8) as hub_norm, round(coalesce(m.authority, 0), 8) as authority_norm,
              round(coalesce(gross_flow, 0), 6) as gross_flow, round(coalesce(flow_in_net_country_norm, 0), 6) as flow_in_net_country_norm
       from (season_degree left join pr_out o using (time, name) left join pr_turned i using (time, name)
             left join hits_raw r using (time, name) left join hits_norm m using (time, name))
       full join (season_gross join season_net using (time, name)) using (time, name)""",
    {
        **pagerank_views(LOCATED, PR_ROUNDS, "pr_out"),
        **pagerank_views(LOCATED, PR_ROUNDS, "pr_turned", turn=True),
        **hits_views(LOCATED, HITS_ROUNDS, "hits_raw"),
        "norm_edges": "select time, src, dst, cnt / sum(cnt) over (partition by time, src) as cnt from located_edges",
        **hits_views("norm_edges", HITS_ROUNDS, "hits_norm"),
    },
)
def _(t):
    out = tables.centrality_table(t.flow(), t.location(), PR_ROUNDS, HITS_ROUNDS)
    eight = [c for c in out.columns if c.startswith(("pr", "hub", "authority"))]
    return rounded(rounded(out, 8, *eight), 6, "gross_flow", "flow_in_net_country_norm")


TYPED = {
    "typed_located": "select * from typed_flow semi join location a on src = a.name semi join location b on dst = b.name",
    "typed_deg": """
        select time, value, name, sum(i)::bigint as flow_in, sum(o)::bigint as flow_out
        from (select time, value, dst as name, cnt as i, 0 as o from typed_located where src <> dst
              union all select time, value, src, 0, cnt from typed_located where src <> dst) group by all""",
    "typed_all": """
        select time, value, name, sum(i)::bigint as all_flow_in, sum(o)::bigint as all_flow_out
        from (select time, value, dst as name, cnt as i, 0 as o from typed_located
              union all select time, value, src, 0, cnt from typed_located) group by all""",
    "typed_gross": """
        select time, value, src as name, sum(case when src <> dst then cnt else 0 end) / sum(cnt) as gross_flow
        from typed_flow group by all""",
    "typed_between_names": """
        select distinct time, value, name from (select time, value, src as name from typed_flow where src <> dst
        union select time, value, dst from typed_flow where src <> dst) semi join location using (name)""",
    "typed_table": """
        select time, value, name, coalesce(flow_in, 0) as flow_in, coalesce(flow_out, 0) as flow_out, coalesce(gross_flow, 0) as gross_flow,
               coalesce(all_flow_in, 0) as all_flow_in, coalesce(all_flow_out, 0) as all_flow_out, d.cnt as jdcount
        from (typed_between_names left join typed_deg using (time, value, name))
        full join typed_gross using (time, value, name) full join typed_all using (time, value, name)
        join (select time, name, type as value, cnt from demand) d using (time, value, name)""",
}


def _per_mille(c, scope, keys):
    return f"round(coalesce({c} * 1000 / nullif(sum({c}) over (partition by {keys}), 0), 0), 6) as {c}_{scope}_norm"


_NORMED = ["flow_in", "flow_out", "all_flow_in", "all_flow_out", "jdcount"]


@query(
    "grf10_typed_centrality_table",
    f"""select time, value, name, flow_in, flow_out, all_flow_in, all_flow_out, jdcount, round(gross_flow, 6) as gross_flow,
              {', '.join(_per_mille(c, 'country', 'time') for c in _NORMED)},
              {', '.join(_per_mille(c, 'name', 'time, name') for c in _NORMED)} from typed_table""",
    TYPED,
)
def _(t):
    out = tables.typed_centrality_table(t.typed_flow(), t.demand(), t.location(), pr_hits=False)
    out = out.drop("flow_in_net", "flow_out_net", "flow_in_net_country_norm", "flow_in_net_name_norm")
    return rounded(out, 6, "gross_flow", *[c for c in out.columns if c.endswith("_norm")])


_BY = ("time", "value")
RANKED = {
    **TYPED,
    "typed_links": "select time, value, src, dst, sum(cnt) as cnt from typed_located where src <> dst group by all",
    "typed_shares": "select time, value, src, dst, cnt / sum(cnt) over (partition by time, value, src) as cnt from typed_links",
    **pagerank_views("typed_links", 4, "typed_out", _BY),
    **pagerank_views("typed_links", 4, "typed_in", _BY, turn=True),
    **hits_views("typed_links", 3, "typed_raw", _BY),
    **hits_views("typed_shares", 3, "typed_norm", _BY),
}
_RANKS = {
    "pr": "o.pr", "pr_norm": "o.pr", "pr_inv": "i.pr", "pr_norm_inv": "i.pr", "hub": "r.hub", "authority": "r.authority",
    "hub_norm": "m.hub", "authority_norm": "m.authority",
}


@query(
    "grf10_typed_centrality_table_with_ranks",
    f"""select time, value, name, flow_in, flow_out, flow_in - flow_out as flow_in_net, flow_out - flow_in as flow_out_net,
              all_flow_in, all_flow_out, jdcount, round(gross_flow, 6) as gross_flow,
              {', '.join(f'round(coalesce({c}, 0), 8) as {name}' for name, c in _RANKS.items())},
              {', '.join(_per_mille(c, 'country', 'time') for c in _NORMED)},
              {', '.join(_per_mille(c, 'name', 'time, name') for c in _NORMED)}
       from typed_table left join typed_out o using (time, value, name) left join typed_in i using (time, value, name)
       left join typed_raw r using (time, value, name) left join typed_norm m using (time, value, name)""",
    RANKED,
)
def _(t):
    out = tables.typed_centrality_table(t.typed_flow(), t.demand(), t.location(), rounds=4, hits_rounds=3)
    out = out.drop("flow_in_net_country_norm", "flow_in_net_name_norm")
    shares = [c for c in out.columns if c.endswith(("_country_norm", "_name_norm"))]
    return rounded(rounded(out, 8, *_RANKS), 6, "gross_flow", *shares)


@query(
    "grf11_undirected_edges",
    "select time, least(src, dst) as src, greatest(src, dst) as dst, sum(cnt)::bigint as cnt from season_edges group by all",
)
def _(t):
    return degree.undirected_edges(t.edges())


SETTINGS = ((0.5, False), (1.0, True))
PASSES = 7


def _pass_sql(k, start="select s, time, name, name as c, k"):
    """Rounds of one pass as one recursive table, until every snapshot rests; then the contraction.

    lp: pairs, lm: places and their community, ls: states by turn, lx: the last state."""
    return {
        f"la{k}": f"select s, time, src, dst, cnt from lp{k} where src <> dst union all select s, time, dst, src, cnt from lp{k} where src <> dst",
        f"lk{k}": f"""select s, time, name, sum(k)::bigint as k from (select s, time, src as name, cnt as k from lp{k}
                      union all select s, time, dst, cnt from lp{k}) group by all""",
        f"ls{k}": f"""
            with recursive st as (
              select 0 as turn, *, false as moved, false as waits, false as swept from ({start} from lk{k})
              union all
              select * from (
                with n as materialized (select *, bool_or(moved or waits) over () as busy from st),
                woken as materialized (
                  select a.s, a.time, a.dst as name from la{k} a join n on n.s = a.s and n.time = a.time and n.name = a.src where n.moved
                  union select s, time, name from n where waits or (not busy and not swept)),
                own as materialized (select n.* from n join woken using (s, time, name)),
                near as materialized (
                  select a.s, a.time, a.src as name, o.c, sum(a.cnt) as k_in from la{k} a join own x on x.s = a.s and x.time = a.time and x.name = a.src
                  join n o on o.s = a.s and o.time = a.time and o.name = a.dst group by all
                  union all select s, time, name, c, 0 from own),
                tot as materialized (select s, time, c, sum(k) as tot from n group by all),
                gains as materialized (
                  select near.s, near.time, near.name, near.c, near.c = own.c as stay,
                         near.k_in::hugeint * m.m * 2 * g.r - own.k::hugeint * (tot - case when near.c = own.c then own.k else 0 end) * 10000 as gain
                  from near join own using (s, time, name) join tot on tot.s = near.s and tot.time = near.time and tot.c = near.c
                  join lmass m on m.s = near.s and m.time = near.time join lset g on g.s = near.s),
                best as materialized (
                  select s, time, name, to_c from (
                    select s, time, name, c as to_c, gain, max(case when stay then gain end) over (partition by s, time, name) as own_gain,
                           row_number() over (partition by s, time, name order by gain desc, c) as i from gains)
                  where i = 1 and gain > own_gain),
                t as (select any_value(turn) as turn from st)
                select t.turn + 1, n.s, n.time, n.name, case when to_c is not null and now then to_c else c end, k,
                       to_c is not null and now, to_c is not null and not now, not busy
                from (select n.*, ascii(md5(concat_ws(':', name, cast(turn // 2 as varchar)))) % 2 = turn % 2 as now from n) n
                left join best using (s, time, name) cross join t
                where exists (select 1 from n where moved or waits or not swept))
            ) select * from st""",
        f"lx{k}": f"select s, time, name, c from ls{k} where turn = (select max(turn) from ls{k})",
        f"lm{k + 1}": f"select m.s, m.time, m.name, x.c from lm{k} m join lx{k} x on x.s = m.s and x.time = m.time and x.name = m.c",
        f"lp{k + 1}": f"""select p.s, p.time, least(a.c, b.c) as src, greatest(a.c, b.c) as dst, sum(cnt)::bigint as cnt from lp{k} p
            join lx{k} a on a.s = p.s and a.time = p.time and a.name = p.src join lx{k} b on b.s = p.s and b.time = p.time and b.name = p.dst group by all""",
    }


def _set_sql(settings):
    return " union all ".join(
        f"select {k} as s, {r}::double as resolution, {str(n).lower()} as normalized, {round(r * 10000)} as r" for k, (r, n) in enumerate(settings)
    )


COMMUNITIES = {
    "lset": _set_sql(SETTINGS),
    "lshare": "select time, src, dst, (cnt * 1000000 // sum(cnt) over (partition by time, src))::bigint as cnt from season_edges",
    "lp0": """select s, time, least(src, dst) as src, greatest(src, dst) as dst, sum(cnt)::bigint as cnt
              from (select normalized, time, src, dst, cnt from season_edges, (select false as normalized) union all select true, * from lshare)
              join lset using (normalized) group by all""",
    "lmass": "select s, time, sum(cnt)::bigint as m from lp0 group by all",
    "lm0": "select distinct s, time, name, name as c from (select s, time, src as name from lp0 union all select s, time, dst from lp0)",
    **{name: sql for k in range(PASSES) for name, sql in _pass_sql(k).items()},
}


@query(
    "grf12_communities",
    f"""select time, name, resolution, normalized, label::integer as label from lm{PASSES} join lset using (s)
        join (select s, time, c, row_number() over (partition by s, time order by count(*) desc, min(name)) - 1 as label
              from lm{PASSES} group by s, time, c) using (s, time, c)""",
    COMMUNITIES,
)
def _(t):
    return community.communities_of(t.edges(), SETTINGS)


# Every quarter but the first starts from the labels that the quarter before has on its own.
WARM = {
    **COMMUNITIES,
    "lset": _set_sql(((1.0, False),)),
    "lfirst": f"""select time as before, name, min(name) over (partition by time, c) as c from lm{PASSES}""",
    "lquarters": "select time, lag(time) over (order by time) as before from (select distinct time from season_edges)",
    "linit": """select time, name, min(name) over (partition by time, c) as c
                from lfirst join lquarters using (before) semi join (select time, name from lk0) using (time, name)""",
}
for _k in range(PASSES):
    _start = "select s, time, name, coalesce((select i.c from linit i where i.time = wk0.time and i.name = wk0.name), name) as c, k"
    for _name, _sql in (_pass_sql(_k, _start) if _k == 0 else _pass_sql(_k)).items():
        WARM["w" + _name[1:]] = re.sub(r"\bl([akxmps])(\d+)\b", r"w\1\2", _sql)
WARM["wp0"], WARM["wm0"] = "select * from lp0", "select * from lm0"


@query(
    "grf12_communities_warm_start",
    f"""select time, name, label::integer as label from wm{PASSES}
        join (select s, time, c, row_number() over (partition by s, time order by count(*) desc, min(name)) - 1 as label
              from wm{PASSES} group by s, time, c) using (s, time, c)""",
    WARM,
)
def _(t):
    edges = materialize(t.edges(), "edges")
    quarters = edges.select("time").distinct()
    follows = quarters.select(F.lead("time").over(Window.orderBy("time")).alias("next"), "time")  # one row per quarter
    cold = community.communities(edges).join(follows, "time").where("next is not null")
    return community.communities(edges, init=cold.select(F.col("next").alias("time"), "name", "label"))


@query(
    "grf13_modularity",
    """with u as (select time, least(src, dst) as a, greatest(src, dst) as b, sum(cnt) as w from season_edges group by all),
            m as (select time, sum(w) as m from u group by all),
            k as (select time, name, sum(w) as k from (select time, a as name, w from u union all select time, b, w from u) group by all),
            i as (select time, sum(w) as inner_w from u join place x on a = x.name join place y on b = y.name where x.province = y.province group by all),
            c as (select time, province, sum(k) as k from k join place using (name) group by all)
       select time, round(0.8 * any_value(inner_w) / any_value(m.m) - sum((c.k / (2 * m.m)) ** 2), 6) as modularity
       from c join m using (time) join i using (time) group by time""".replace("with u as", "select * from (with u as", 1) + ")",
)
def _(t):
    pairs = degree.undirected_edges(t.edges())
    provinces = t.place().select("name", F.col("province").alias("label"))
    labels = vertices_of(pairs, ["time"]).join(provinces, "name")
    return rounded(community.modularity(pairs, labels, resolution=0.8), 6, "modularity")


def _align_sql():
    """Greedy matching by repeated choice of the best free pair."""
    views = {
        "overlap": """
            select a.label as u, b.label as p, count(*) as n from season_label a join season_label b using (name)
            where a.time = '1996Q2' and b.time = '1996Q1' group by all""",
    }
    for i in range(1, 6):
        taken = "".join(f" and u not in (select u from pick{k}) and p not in (select p from pick{k})" for k in range(1, i))
        views[f"pick{i}"] = f"select u, p from overlap where true{taken} order by n desc, u, p limit 1"
    views["pairs"] = " union all ".join(f"select * from pick{i}" for i in range(1, 6))
    return views


@query(
    "grf14_align_labels",
    """select name, label::integer as label from season_label where time = '1996Q1' and false union all
       select name, coalesce(p, free.l)::integer from season_label left join pairs on label = u
       left join (select a.u as fu, b.l from
            (select u, row_number() over (order by u) as i from (select distinct label as u from season_label where time = '1996Q2') where u not in (select u from pairs)) a
            join (select l, row_number() over (order by l) as i from range(50) r(l) where l not in (select p from pairs)) b using (i)) free on label = fu
       where time = '1996Q2'""",
    _align_sql(),
)
def _(t):
    labels = materialize(t.season_label().where("time in ('1996Q1', '1996Q2')"), "labels")
    history = community.label_history(labels.where("time = '1996Q1'"))
    return community.align_step(labels.where("time = '1996Q2'").select("name", "label"), history)


ALIGNED = ["1996Q1", "1996Q2", "1996Q3", "1996Q4"]


def _chain_sql():
    """Each part matched to what all earlier parts were renamed to."""
    views = {"al0": f"select name, label::integer as label from season_label where time = '{ALIGNED[0]}'"}
    for t, part in enumerate(ALIGNED[1:], 1):
        earlier = " union all ".join(f"select * from al{k}" for k in range(t))
        views[f"hist{t}"] = f"select name, label, count(*) as times from ({earlier}) group by all"
        views[f"now{t}"] = f"select name, label::integer as label from season_label where time = '{part}'"
        views[f"ov{t}"] = f"select c.label as u, h.label as p, sum(times) as n from now{t} c join hist{t} h using (name) group by all"
        for i in range(5):
            taken = "".join(f" and u not in (select u from pk{t}x{k}) and p not in (select p from pk{t}x{k})" for k in range(i))
            views[f"pk{t}x{i}"] = f"select u, p from ov{t} where true{taken} order by n desc, u, p limit 1"
        views[f"prs{t}"] = " union all ".join(f"select * from pk{t}x{i}" for i in range(5))
        views[f"new{t}"] = f"""select u, row_number() over (order by u) as i from (select distinct label as u from now{t})
            where u not in (select u from prs{t})"""
        views[f"fre{t}"] = f"select l, row_number() over (order by l) as i from range(50) r(l) where l not in (select p from prs{t})"
        views[f"al{t}"] = f"""select name, coalesce(p, l)::integer as label from now{t} left join prs{t} on label = u
            left join (select u as fu, l from new{t} join fre{t} using (i)) on label = fu"""
    return views


@query(
    "grf14_align_labels_over_time",
    " union all ".join(f"select '{part}' as part, name, label from al{t}" for t, part in enumerate(ALIGNED)),
    _chain_sql(),
)
def _(t):
    labels = t.season_label().withColumnRenamed("time", "part")
    return community.align_labels(materialize(labels, "labels"), ALIGNED)


@query(
    "grf15_edge_colors",
    """select e.time, e.src, e.dst, e.cnt, case when e.src in ('NATION_2') or e.dst in ('NATION_2') then -1
              when a.label = b.label then a.label else -1 end::integer as color
       from season_edges e left join season_label a on e.time = a.time and e.src = a.name
       left join season_label b on e.time = b.time and e.dst = b.name""",
)
def _(t):
    edges = t.edges()
    colored = degree.edge_colors(edges, t.season_label(), grey=["NATION_2"])
    return colored.select("time", "src", "dst", "cnt", "color")


@query(
    "grf16_vertex_weights",
    """select time, name, coalesce(cnt, 0)::bigint as weight from (select time, src as name from season_edges union select time, dst from season_edges)
       left join (select time, name, cnt from demand where type = 'PROMO') using (time, name)""",
)
def _(t):
    promo = t.demand().where("type = 'PROMO'")
    return degree.vertex_weights(vertices_of(t.edges(), ["time"]), promo, "cnt")


@query(
    "grf17_aggregate_by_group",
    """select time, a.tier as src, b.tier as dst, sum(cnt)::bigint as cnt from season_flow
       join tiers a on src = a.name join tiers b on dst = b.name group by all""",
)
def _(t):
    return degree.aggregate_by_group(t.flow(), t.tiers(), "tier")


@query(
    "grf18_region_subgraph",
    """select time, src, dst, cnt from season_edges semi join (select name from region_city where region = 'R2') a on src = a.name
       semi join (select name from region_city where region = 'R2') b on dst = b.name""",
)
def _(t):
    return degree.region_subgraph(t.edges(), t.region_city().where("region = 'R2'").select("name"))
