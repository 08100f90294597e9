"""Tables of the map pages."""

from pyspark.sql import functions as F

from odflux.catalog.analyses import MISMATCH, MISMATCH_COLUMNS, _supply
from odflux.catalog.aggregates import _category_sql
from odflux.catalog.filters import _class_sql
from odflux.catalog.graphs import TYPED
from odflux.catalog.inputs import rounded
from odflux.catalog.registry import query
from odflux.functions.scalars import SIZE_BOUNDS
from odflux.graph.degree import degrees
from odflux.graph.tables import typed_centrality_table
from odflux.operators.aggregates import category_sum, share_of_group
from odflux.plans import maps, mismatch
from odflux.session import materialize

TIME = "1997Q4"
MAP = {
    "g": "select * from located_edges where time = '1997Q4'",
    "heavy": "select * from g where cnt > 3",
    "heavy_v": "select src as name from heavy union select dst from heavy",
    "old_name": "select name, concat(name, '_OLD') as alias from place where place_key % 9 = 4",
}


@query(
    "ana19_nodes",
    f"""select name, round(ll_x, 2) as x, round(ll_y, 2) as y, round(w, 4) as value,
               ({_class_sql(SIZE_BOUNDS['hub'])} * 4)::integer as symbol_size, coalesce(tier, 5)::integer as tier_class
        from (select name, ll_x, ll_y, coalesce(hub, 0) as w, coalesce(hub, 0) as v, tier from heavy_v
              left join (select name, hub from score where time = '1997Q4') using (name) join location using (name) left join tiers using (name))""",
    MAP,
)
def _(t):
    return maps.nodes(t.edges(), t.score(), t.location(), t.tiers(), TIME, "hub", 3, 4.0)


@query(
    "ana19_nodes_of_region",
    """with r as (select * from g where src in (select name from region_city where region = 'R3') and dst in (select name from region_city where region = 'R3')),
            v as (select src as name from r union select dst from r)
       select name, round(ll_x, 2) as x, round(ll_y, 2) as y, round(flow_in::double, 4) as value, (flow_in * 0.5)::integer as symbol_size,
              coalesce(tier, 5)::integer as tier_class
       from v join (select name, flow_in - flow_in % 2 as flow_in from score where time = '1997Q4') using (name) join location using (name)
       left join tiers using (name)""".replace("with r as", "select * from (with r as", 1) + ")",
    MAP,
)
def _(t):
    region = t.region_city().where("region = 'R3'").select("name")
    scores = t.score().withColumn("flow_in", (F.col("flow_in") - F.col("flow_in") % 2).cast("double"))
    return maps.nodes(t.edges(), scores, t.location(), t.tiers(), TIME, "flow_in", 0, 0.5, region=region)


@query(
    "ana19_links",
    """select src, dst, round(a.ll_x, 2) as src_x, round(a.ll_y, 2) as src_y, round(b.ll_x, 2) as dst_x, round(b.ll_y, 2) as dst_y,
              coalesce(tier, 5)::integer as src_tier
       from heavy join location a on src = a.name join location b on dst = b.name left join tiers t on src = t.name""",
    MAP,
)
def _(t):
    return maps.links(t.edges(), t.location(), t.tiers(), TIME, 3)


_RANGE = """case when {s} and min(w) over () < 0 then -least(abs(min(w) over ()), abs(max(w) over ())) else min(w) over () end as min_w,
            case when {s} and min(w) over () < 0 then least(abs(min(w) over ()), abs(max(w) over ())) else max(w) over () end as max_w"""


def _painted(rows, columns="value, min_w, max_w"):
    """Rows plus those under an old name."""
    return f"""with p as ({rows}) select name, {columns} from p
               union all select alias, {columns} from p join old_name using (name)"""


def _wrap(sql):
    return f"select * from ({sql})"


@query(
    "ana20_choropleth",
    _wrap(_painted(f"""select name, round(w, 4) as value, {_RANGE.format(s='true')} from (select name, coalesce(flow_in_net, 0)::double as w
        from (select src as name from g union select dst from g) left join (select * from score where time = '1997Q4') using (name))""")),
    MAP,
)
def _(t):
    return maps.choropleth(t.edges(), t.score(), t.location(), t.aliases(), TIME, "flow_in_net")


@query(
    "ana20_choropleth_of_demand",
    _wrap(_painted(f"""select name, round(w, 4) as value, {_RANGE.format(s='false')} from (select name, coalesce(greatest("jd_All", 30000), 0)::double as w
        from (select src as name from g union select dst from g) left join (select * from jobs where time = '1997Q4') using (name))""")),
    {**MAP, "jobs": _category_sql()},
)
def _(t):
    return maps.choropleth(t.edges(), category_sum(t.topic_count()), t.location(), t.aliases(), TIME, "jd_All")


def _wide_sql(metric, times):
    picks = ", ".join(f"max(case when time = '{x}' then {metric} end) as t{i}" for i, x in enumerate(times))
    full = " and ".join(f"t{i} is not null" for i in range(len(times)))
    return f"select * from (select name, {picks} from score group by name) where {full}"


COMPARED = {
    **MAP,
    "ratio_wide": _wide_sql("flow_in", ["1996Q4", "1997Q4", "1998Q4"]),
    "ratio_change": """select name, case when t0 > 0.01 * (select sum(t0) from ratio_wide) then (t1 - t0) / t0 else 0 end as c from ratio_wide""",
    "trend_wide": _wide_sql("flow_in", ["1998Q1", "1997Q1", "1997Q4", "1996Q4"]),
    "trend_change": """select name, case when t0 > 0.0005 * (select sum(t0) from trend_wide) then t1 / t0 * (case when t3 > 0 then t2 / t3 else 0 end) - 1 else 0 end as c from trend_wide""",
    "net_wide": _wide_sql("flow_in_net", ["1996Q4", "1997Q4"]),
    "net_change": """select name, least(greatest(case when t0 > 0.0005 * (select sum(t0) from net_wide) then (t1 - t0) / t0 else 0 end, -0.5), 0.5) as c from net_wide""",
}
_COMPARE_RANGE = """case when min(w) over () < 0 then -(case when max(w) over () > 0 then least(abs(min(w) over ()), abs(max(w) over ())) else abs(min(w) over ()) end)
                         else min(w) over () end as min_w,
                    case when min(w) over () < 0 then (case when max(w) over () > 0 then least(abs(min(w) over ()), abs(max(w) over ())) else abs(min(w) over ()) end)
                         else max(w) over () end as max_w"""


def _compare_sql(change, time):
    rows = f"""select name, round(w, 4) as value, {_COMPARE_RANGE} from (select name, coalesce(c, 0) as w
        from (select src as name from located_edges where time = '{time}' union select dst from located_edges where time = '{time}')
        left join {change} using (name))"""
    return f"select name, value, round(min_w, 6) as min_w, round(max_w, 6) as max_w from ({_painted(rows)})"


def _compared(t, changes, check, metric="flow_in"):
    out = maps.comparison_map(changes, t.edges(), t.location(), t.aliases(), check, metric)
    return rounded(out, 6, "min_w", "max_w")


@query("ana21_period_comparison", _compare_sql("ratio_change", "1997Q4"), COMPARED)
def _(t):
    return _compared(t, maps.period_comparison(t.score(), "flow_in", "1996Q4", "1997Q4", ["1998Q4"], threshold=0.01), "1997Q4")


@query("ana21_period_comparison_estimate", _compare_sql("trend_change", "1997Q1"), COMPARED)
def _(t):
    changes = maps.period_comparison(t.score(), "flow_in", "1998Q1", "1997Q1", [], trend=("1997Q4", "1996Q4"))
    return _compared(t, changes, "1997Q1")


@query("ana21_period_comparison_clamped", _compare_sql("net_change", "1997Q4"), COMPARED)
def _(t):
    changes = maps.period_comparison(t.score(), "flow_in_net", "1996Q4", "1997Q4", [])
    return _compared(t, changes, "1997Q4", "flow_in_net")


@query(
    "ana21_region_comparison",
    """select name, round(case when name in (select src from season_flow where time = '1996Q4' group by src having sum(cnt) > 75) and
              t0 > 0.0005 * (select sum(t0) from ratio_wide) then (t1 - t0) / t0 else 0 end, 6) as change from ratio_wide""",
    COMPARED,
)
def _(t):
    sums = t.flow().groupBy("time", F.col("src").alias("name")).agg(F.sum("cnt").alias("cnt"))
    sources = maps.supported_sources(sums, "1996Q4", 75)
    changes = maps.period_comparison(t.score(), "flow_in", "1996Q4", "1997Q4", ["1998Q4"], sources=sources)
    return rounded(changes, 6, "change")


@query(
    "ana22_cluster_places",
    """with p as (select name, coalesce(label, -1)::integer as cluster from (select src as name from g union select dst from g)
                  left join (select * from season_label where time = '1997Q4') using (name))
       select * from p union all select alias, cluster from p join old_name using (name)""".replace("with p as", "select * from (with p as", 1) + ")",
    MAP,
)
def _(t):
    return maps.cluster_places(t.edges(), t.season_label(), t.location(), t.aliases(), TIME)


@query(
    "ana22_cluster_nodes",
    """select name, round(ll_x, 2) as x, round(ll_y, 2) as y, coalesce(label, -1)::integer as cluster from heavy_v join location using (name)
       left join (select * from season_label where time = '1997Q4') using (name) where name <> 'NATION_2'""",
    MAP,
)
def _(t):
    return maps.cluster_nodes(t.edges(), t.season_label(), t.location(), TIME, 3, unplaced=["NATION_2"])


@query(
    "ana22_cluster_nodes_clustered",
    """select name, round(ll_x, 2) as x, round(ll_y, 2) as y, label as cluster from (select src as name from g union select dst from g) join location using (name)
       join (select * from season_label where time = '1997Q4' and label <> 3) using (name)""",
    MAP,
)
def _(t):
    labels = t.season_label().where("label <> 3")
    return maps.cluster_nodes(t.edges(), labels, t.location(), TIME, 3, only_clustered=True)


@query(
    "ana22_cluster_links",
    """select src, dst, round(a.ll_x, 2) as src_x, round(a.ll_y, 2) as src_y, round(b.ll_x, 2) as dst_x, round(b.ll_y, 2) as dst_y,
              (case when x.label = y.label then x.label else -1 end)::integer as color
       from heavy join location a on src = a.name join location b on dst = b.name
       left join (select * from season_label where time = '1997Q4') x on src = x.name
       left join (select * from season_label where time = '1997Q4') y on dst = y.name where src <> 'NATION_2' and dst <> 'NATION_2'""",
    MAP,
)
def _(t):
    return maps.cluster_links(t.edges(), t.season_label(), t.location(), TIME, 3, unplaced=["NATION_2"])


@query(
    "ana23_typed_choropleth",
    _wrap(_painted(f"""select name, round(w, 4) as value, {_RANGE.format(s='true')} from (select name, coalesce(flow_in, 0)::double as w
        from (select src as name from typed_located where time = '1997Q4' and value = 'SMALL' and src <> dst
              union select dst from typed_located where time = '1997Q4' and value = 'SMALL' and src <> dst)
        left join (select * from typed_table where time = '1997Q4' and value = 'SMALL') using (name))""")),
    {**MAP, **TYPED},
)
def _(t):
    typed = materialize(t.typed_flow(), "typed")
    scores = typed_centrality_table(typed, t.demand(), t.location(), pr_hits=False)
    return maps.typed_choropleth(typed.where("src <> dst"), scores, t.location(), t.aliases(), "SMALL", TIME, "flow_in")


@query(
    "ana24_regional_mismatch_map",
    _wrap(_painted("""select name, round(coalesce(industry_mismatch, 0), 4) as value, round((select min(industry_mismatch) from city_mismatch), 6) as min_w,
                             round((select max(industry_mismatch) from city_mismatch), 6) as max_w
        from (select src as name from region_graph union select dst from region_graph) left join (select * from city_mismatch where time = '1997Q4') using (name)""")),
    {
        **MAP, **MISMATCH,
        "region_graph": """select * from g where src in (select name from region_city where region = 'R3') and dst in (select name from region_city where region = 'R3')""",
    },
)
def _(t):
    table = materialize(mismatch.city_mismatch(t.demand(), _supply(t), "1996Q4", "PROMO", k=2), "mismatch")
    assert set(MISMATCH_COLUMNS) <= set(table.columns)
    region = t.region_city().where("region = 'R3'").select("name")
    out = maps.regional_mismatch_map(table, t.edges(), region, t.location(), t.aliases(), TIME, "industry_mismatch")
    return rounded(out, 6, "min_w", "max_w")


def _topic_places(t):
    sums = t.topic_count().groupBy("topic", F.col("name").alias("word")).agg(F.sum("cnt").alias("cnt"))
    return share_of_group(sums, ["topic"], "cnt", "prob")


@query(
    "ana25_topic_source_map",
    """with p as (select name, least(round(sum(cnt) / sum(sum(cnt)) over (), 4), 0.05 * 2) as value from topic_count where topic = 4 group by name)
       select * from p union all select alias, value from p join old_name using (name)""".replace("with p as", "select * from (with p as", 1) + ")",
    MAP,
)
def _(t):
    return maps.topic_source_map(_topic_places(t), 4, t.aliases())


@query("ana25_topic_list", "select t::integer as topic from range((select max(topic) + 1 from topic_count)) r(t)")
def _(t):
    return maps.topic_list(_topic_places(t))
