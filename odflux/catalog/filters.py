"""Filters, projections, sorts and set operations."""

from pyspark.sql import functions as F

from odflux.catalog.inputs import rounded
from odflux.catalog.registry import query
from odflux.catalog.sources import write_log
from odflux.functions import scalars
from odflux.operators import aggregates, filters, projections, ranking, setops, sorting
from odflux.sources import files

WORDS = ["the ", "ción", "sch"]


@query(
    "fil01_filter_any_keyword",
    "select doc_id, lang from documents where contains(text, 'the ') or contains(text, 'ción') or contains(text, 'sch')",
)
def _(t):
    return filters.filter_any_keyword(t.documents, "text", WORDS).select("doc_id", "lang")


@query(
    "fil02_safe_parse",
    """select query, title, userid, strftime(event_time, '%Y-%m-%d %H:%M:%S') as event_time, round(x, 6) as x, round(y, 6) as y
       from log_event where event_id % 7 <> 0 and event_id % 11 <> 0""",
)
def _(t):
    parsed = filters.safe_parse(files.scan_event_log(t.spark, write_log(t)))
    return rounded(parsed.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")), 6, "x", "y")


@query(
    "fil03_drop_nulls",
    "select d.doc_id, l.quality from documents d left join labels l using (doc_id) where l.quality is not null",
)
def _(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality")
    return filters.drop_nulls(joined, ["quality"])


@query(
    "fil04_drop_sentinel",
    "select time, src, dst, cnt from season_flow where src <> 'NATION_7' and dst <> 'NATION_7'",
)
def _(t):
    return filters.drop_sentinel(t.flow(), ["src", "dst"], "NATION_7")


@query("fil05_drop_self_edges", "select time, src, dst, cnt from season_flow where src <> dst")
def _(t):
    return filters.drop_self_edges(t.flow())


@query(
    "fil06_filter_members",
    """select time, src, dst, cnt from season_flow where src in ('NATION_1', 'NATION_2', 'NATION_3')
       and dst in (select name from region_city where region = 'R2')""",
)
def _(t):
    edges = filters.filter_members(t.flow(), "src", ["NATION_1", "NATION_2", "NATION_3"])
    return filters.filter_members(edges, "dst", t.region_city().where("region = 'R2'").select("name"))


@query(
    "fil06_filter_non_members",
    """select time, src, dst, cnt from season_flow where src not in (select name from region_city)
       and time not in ('1996Q1', '1997Q1')""",
)
def _(t):
    edges = filters.filter_members(t.flow(), "src", t.region_city().select("name"), negate=True)
    return filters.filter_members(edges, "time", ["1996Q1", "1997Q1"], negate=True)


@query("fil07_filter_period", "select time, src, dst, cnt from season_flow where time between '1996Q2' and '1999Q3'")
def _(t):
    return filters.filter_period(t.flow(), "1996Q2", "1999Q3")


@query(
    "fil08_drop_boundary_periods",
    "select time, src, dst, cnt from season_flow where time between '1996Q1' and '1998Q2'",
)
def _(t):
    return filters.drop_boundary_periods(t.flow(), (1996, 2), (1998, 5), "season")


@query("fil09_filter_quarter", "select time, src, dst, cnt from season_flow where time like '%Q4'")
def _(t):
    return filters.filter_quarter(t.flow(), 4)


@query("fil10_exclude_category", "select time, name, type, cnt from demand where type <> 'PROMO'")
def _(t):
    return filters.exclude_category(t.demand(), "type", "PROMO")


@query("fil11_filter_by_edge_weight", "select time, src, dst, cnt from season_edges where cnt > 4")
def _(t):
    return filters.filter_by_edge_weight(t.edges(), 4)[0]


@query(
    "fil11_vertices_of_heavy_edges",
    "select time, src as name from season_edges where cnt > 7 union select time, dst from season_edges where cnt > 7",
)
def _(t):
    return filters.filter_by_edge_weight(t.edges(), 7, by=["time"])[1]


@query(
    "fil11_vertices_of_all_edges",
    "select time, src as name from season_edges union select time, dst from season_edges",
)
def _(t):
    return filters.filter_by_edge_weight(t.edges(), 7, filter_vertices=False, by=["time"])[1]


@query("fil12_min_support", "select src, dst, sum(cnt)::bigint as cnt from season_flow group by all having sum(cnt) > 80")
def _(t):
    return filters.min_support(aggregates.sum_by(t.flow(), ["src", "dst"], ["cnt"]), "cnt", 80)


MD5 = "('0x' || substr(md5(concat_ws('|', cast(doc_id as varchar), '42')), 1, 8))::bigint"


@query("fil13_sample_fraction", f"select doc_id, lang from documents where {MD5} < 429496729")
def _(t):
    return filters.sample_fraction(t.documents.select("doc_id", "lang"), 0.1, ["doc_id"])


@query("fil13_sample_n", f"select doc_id, lang from documents order by {MD5}, doc_id limit 200")
def _(t):
    return filters.sample_n(t.documents.select("doc_id", "lang"), 200, ["doc_id"])


# Six standard deviations around a tenth of the rows.
@query("fil13_sample_bernoulli", "select true as in_bounds, count(*) as total from documents")
def _(t):
    rows = t.documents.select("doc_id", "lang")
    sampled = filters.sample_fraction(rows, 0.1).agg(F.count("*").alias("n"))
    gap = F.abs(F.col("n") - 0.1 * F.col("total"))
    return sampled.crossJoin(rows.agg(F.count("*").alias("total"))).select(
        (gap <= 6 * F.sqrt(0.09 * F.col("total"))).alias("in_bounds"), "total"
    )


# ---- projections ---------------------------------------------------------------

@query("prj01_project", "select 'all' as period, c_name as name, round(c_acctbal, 0) as pay from customer")
def _(t):
    return projections.project(
        t.customer.select("c_custkey", "c_name", "c_acctbal"), rename={"c_acctbal": "pay", "c_name": "name"},
        drop=["c_custkey"], constants={"period": "all"}, rounding={"pay": 0}, order=["period", "name", "pay"],
    )


def _class_sql(bounds):
    arms = " ".join(f"when v > {b} then {i + 1}" for i, b in reversed(list(enumerate(bounds))) if i)
    return f"case {arms} else 1 end"


@query(
    "prj02_bucket_by_bounds",
    f"""select time, name, {_class_sql(scalars.SIZE_BOUNDS['pr'])} as size_class
        from (select time, src as name, greatest(round(sum(cnt) / any_value(total), 6) - 0.03, 0) as v
              from season_flow join (select time, sum(cnt) as total from season_flow group by all) using (time) group by all)""",
)
def _(t):
    out = t.flow().groupBy("time", F.col("src").alias("name")).agg(F.sum("cnt").alias("cnt"))
    share = aggregates.share_of_group(out, ["time"]).withColumn("v", F.round("ratio", 6) - 0.03)
    return projections.size_class(share, "v", "pr").select("time", "name", "size_class")


@query("prj03_floor_value", "select time, src, dst, greatest(cnt, 5) as cnt from season_flow")
def _(t):
    return t.flow().withColumn("cnt", scalars.floor_value("cnt", 5))


@query("prj04_clamp", "select user_id, event_id, least(greatest(value - 20, -7.5), 7.5) as v from events")
def _(t):
    return t.events.select("user_id", "event_id", scalars.clamp(F.col("value") - 20, -7.5, 7.5).alias("v"))


@query(
    "prj05_expand_alias",
    """select time, src as name, sum(cnt)::bigint as cnt from season_flow group by all
       union all
       select time, concat(src, '_OLD'), sum(cnt)::bigint from season_flow join place on src = name
       where place_key % 9 = 4 group by all""",
)
def _(t):
    out = t.flow().groupBy("time", F.col("src").alias("name")).agg(F.sum("cnt").alias("cnt"))
    return projections.expand_alias(out, t.aliases())


# ---- sorts -----------------------------------------------------------------------

@query("srt01_sort_by", "select time, src, dst, cnt from season_flow order by time, cnt, src, dst")
def _(t):
    return sorting.sort_by(t.flow(), ["time", "cnt", "src", "dst"])


@query("srt02_top_k", "select name, round(gdp, 4) as gdp from gdp order by gdp desc, name limit 10")
def _(t):
    return rounded(sorting.top_k(t.gdp(), "gdp", 10), 4, "gdp")


@query("srt03_timeline", "select distinct time from season_flow order by time")
def _(t):
    return sorting.timeline(t.flow())


@query(
    "srt04_order_by_list",
    """select type, count(*) as cnt, list_position(['SMALL', 'MEDIUM', 'LARGE', 'ECONOMY', 'STANDARD', 'PROMO'], type)::integer as type_id
       from demand group by all order by 3""",
)
def _(t):
    order = ["SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD", "PROMO"]
    return sorting.order_by_list(aggregates.count_by(t.demand(), "type"), "type", order)


# ---- sets ------------------------------------------------------------------------

@query("set01_append", "select time, src, dst, cnt from season_flow union all select time, src, dst, cnt from month_flow")
def _(t):
    return setops.append(t.flow("season"), t.flow("month"))


@query(
    "set02_intersect_places",
    "(select src as name from season_edges union select dst from season_edges) intersect select name from location",
)
def _(t):
    return setops.intersect_places(t.edges(), t.location())


@query("set03_vertices", "select src as name from season_edges union select dst from season_edges")
def _(t):
    return setops.vertices(t.edges())


@query(
    "set04_carry_forward_year",
    "select year, name, round(wage, 4) as wage from wage union all select 2002, name, round(wage, 4) from wage where year = 2001",
)
def _(t):
    return rounded(setops.carry_forward_year(t.wage(), 2001, 2002), 4, "wage")


@query(
    "set05_remove_members",
    """select distinct src, dst from season_flow where not exists
       (select 1 from (select distinct src as s, dst as d from season_flow where cnt > 6) where s = src and d = dst)""",
)
def _(t):
    flow = t.flow()
    return setops.remove_members(
        flow.select("src", "dst").distinct(), flow.where("cnt > 6").select("src", "dst").distinct(), ["src", "dst"]
    )


@query(
    "win04_top_k_by_rank",
    """select time, name, type, rank from (select *, rank() over (partition by time, name order by cnt desc)
       + (count(*) over (partition by time, name, cnt) - 1) / 2 as rank from demand) where rank <= 2""",
)
def _(t):
    ranked = ranking.average_rank_desc(t.demand(), ["time", "name"], "cnt")
    return ranking.top_k_by_rank(ranked, "rank", 2).select("time", "name", "type", "rank")
