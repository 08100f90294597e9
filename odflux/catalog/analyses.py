"""End-user analyses: centrality, income, demand, mismatch."""

from pyspark.sql import functions as F

from odflux.catalog.aggregates import _category_sql
from odflux.catalog.graphs import TYPED
from odflux.catalog.inputs import rounded
from odflux.catalog.registry import query
from odflux.graph.tables import typed_centrality_table
from odflux.operators.aggregates import category_sum
from odflux.plans import centrality, demand, income, mismatch
from odflux.plans.flows import net_inflow_by_quarter
from odflux.session import materialize

TIMES = ["1996Q4", "1997Q4", "1998Q4"]


@query(
    "net_inflow_by_quarter",
    """select time, name, round((sum(i) - sum(o)) * 1000 / any_value(total), 6) as flow_in_net_country_norm
       from (select time, dst as name, cnt as i, 0 as o from season_flow union all select time, src, 0, cnt from season_flow)
       join (select time, sum(cnt) as total from season_flow group by all) using (time) group by time, name""",
)
def _(t):
    return rounded(net_inflow_by_quarter(t.flow()), 6, "flow_in_net_country_norm")


@query(
    "ana02_tier_trend",
    """select time, tier, round(sum(authority), 6) as authority, round(sum(hub), 6) as hub, round(avg(gross_flow), 6) as gross_flow,
              round(avg(flow_in_net_country_norm), 6) as flow_in_net_country_norm,
              ['Tier 1', 'New tier 1', 'Tier 2', 'Tier 3', 'Tier 4', 'Tier 5'][tier + 1] as tier_name, tier in (0, 1) as top
       from score join tiers using (name) group by all""",
)
def _(t):
    return rounded(centrality.tier_trend(t.score(), t.tiers()), 6, "authority", "hub", "gross_flow", "flow_in_net_country_norm")


@query(
    "ana02_tier_boxes",
    """with b as (select time, tier, count(*) as n, quantile_cont(hub, [0, 0.25, 0.5, 0.75, 1]) as q
                  from score join tiers using (name) where time in ('1996Q4', '1997Q4', '1998Q4') group by time, tier),
            s as (select b.*, hub, hub between q[2] - 1.5 * (q[4] - q[2]) and q[4] + 1.5 * (q[4] - q[2]) as inside
                  from score join tiers using (name) join b using (time, tier))
       select time, tier, any_value(n) as n, round(any_value(q[1]), 6) as minimum, round(any_value(q[2]), 6) as q1,
              round(any_value(q[3]), 6) as median, round(any_value(q[4]), 6) as q3, round(any_value(q[5]), 6) as maximum,
              round(min(hub) filter (inside), 6) as whisker_low, round(max(hub) filter (inside), 6) as whisker_high
       from s group by time, tier""".replace("with b as", "select * from (with b as", 1) + ")",
)
def _(t):
    box = centrality.tier_boxes(t.score(), t.tiers(), "hub", TIMES)
    return rounded(box, 6, "minimum", "q1", "median", "q3", "maximum", "whisker_low", "whisker_high")


@query(
    "ana03_city_lines",
    """select concat('Place ', place_key) as city, time, round(authority, 6) as authority, round(hub, 6) as hub,
              strftime(make_date(cast(time[1:4] as integer), cast(time[6:6] as integer) * 3 - 2, 1), '%Y-%m-%d') as period
       from score join place using (name) where place_key < 6""",
)
def _(t):
    lines = centrality.city_lines(t.score(), [f"NATION_{i}" for i in range(6)], t.translation())
    return rounded(lines.withColumn("period", F.date_format("period", "yyyy-MM-dd")), 6, "authority", "hub")


def _at(metric, time):
    return f"max(case when time = '{time}' then {metric} end)"


@query(
    "ana04_change_by_tier",
    f"""with w as (select name, {_at('authority', '1996Q4')} as a4, {_at('authority', '1997Q4')} as b4, {_at('authority', '1997Q1')} as a1,
                   {_at('authority', '1998Q1')} as b1 from score group by name)
        select name, tier, 'Q4' as metric, round((b4 - a4) / a4, 6) as increase from w join tiers using (name)
        union all select name, tier, 'Q1', round((b1 - a1) / a1, 6) from w join tiers using (name)""".replace("with w as", "select * from (with w as", 1) + ")",
)
def _(t):
    pairs = {"Q4": ("1997Q4", "1996Q4"), "Q1": ("1998Q1", "1997Q1")}
    return rounded(centrality.change_by_tier(t.score(), t.tiers(), "authority", pairs), 6, "increase")


@query(
    "ana04_second_order_change",
    f"""with w as (select name, {_at('flow_in', '1996Q4')} as a, {_at('flow_in', '1997Q1')} as b, {_at('flow_in', '1997Q4')} as c,
                   {_at('flow_in', '1998Q1')} as d from score group by name)
        select name, round((a - b) / b, 6) as first, round((c - d) / d, 6) as second,
               round(((a - b) / b - (c - d) / d) / nullif((c - d) / d, 0), 6) as change from w
        where a is not null and b is not null and c is not null and d is not null""".replace("with w as", "select * from (with w as", 1) + ")",
)
def _(t):
    change = centrality.second_order_change(t.score(), "flow_in", ("1996Q4", "1997Q1"), ("1997Q4", "1998Q1"))
    return rounded(change, 6, "first", "second", "change")


@query(
    "ana05_tier_flow_change",
    """with s as (select time, a.tier as src, b.tier as dst, sum(cnt) as cnt from season_flow join tiers a on src = a.name
                  join tiers b on dst = b.name group by all),
            p as (select time, src, dst, cnt / sum(cnt) over (partition by time, src) as share from s),
            c as (select concat(n.time, '/', b.time) as periods, n.src as tier, n.dst, n.share / b.share - 1 as x
                  from p n join p b on n.src = b.src and n.dst = b.dst
                  where (n.time = '1997Q4' and b.time = '1996Q4') or (n.time = '1997Q1' and b.time = '1998Q1'))
       select periods, tier, """.replace("with s as", "select * from (with s as", 1)
    + ", ".join(f"round(max(case when dst = {i} then x end), 6) as to_{i}" for i in range(6))
    + " from c group by all)",
)
def _(t):
    out = centrality.tier_flow_change(t.flow(), t.tiers(), [("1997Q4", "1996Q4"), ("1997Q1", "1998Q1")])
    return rounded(out, 6, *[f"to_{i}" for i in range(6)])


@query(
    "ana06_gdp_correlation",
    " union all ".join(
        f"""select '{c}' as metric, round(corr(s.{c}, g.gdp), 3) as coefficient from score s join gdp g using (name) where time = '1997Q4'"""
        for c in ("flow_in", "flow_out", "flow_in_net", "hub", "authority")
    ),
)
def _(t):
    columns = ["flow_in", "flow_out", "flow_in_net", "hub", "authority"]
    return centrality.gdp_correlation(t.score(), t.gdp(), ["1996Q4", "1997Q4"], columns=columns).select("metric", "coefficient")


@query(
    "ana07_hub_authority_classes",
    """select time, name, tier, round(hub, 6) as hub, round(authority, 6) as authority, round((hub + 1e-9) / (authority + 1e-9), 4) as ratio,
              round(median(authority) over (partition by time, tier), 6) as authority_median,
              round(median(hub) over (partition by time, tier), 6) as hub_median
       from score join tiers using (name)""",
)
def _(t):
    out = centrality.hub_authority_classes(t.score(), t.tiers()).drop("quadrant")
    return rounded(rounded(out, 4, "ratio"), 6, "hub", "authority", "hub_median", "authority_median")


@query(
    "ana07_hub_authority_quadrants",
    """with q as (select time, tier, (flow_in >= median(flow_in) over (partition by time, tier)) as a,
                         (flow_out >= median(flow_out) over (partition by time, tier)) as h from score join tiers using (name))
       select time, tier, (2 * a::integer + h::integer)::integer as quadrant, count(*) as n from q group by all""".replace("with q as", "select * from (with q as", 1) + ")",
)
def _(t):
    scores = t.score().select("time", "name", F.col("flow_in").alias("authority"), F.col("flow_out").alias("hub"))
    out = centrality.hub_authority_classes(scores, t.tiers())
    return out.groupBy("time", "tier", "quadrant").agg(F.count("*").alias("n"))


# ---- income ------------------------------------------------------------------------

WAGES = {
    "wages": "select * from wage where year <= 2000 union all select 2001, name, wage from wage where year = 2000",
    "pay": """
        select f.time, f.src as name, f.value, sum(coalesce(b.wage - a.wage, 0) * f.cnt) as salary_diff_weighted, sum(f.cnt)::bigint as cnt
        from typed_flow f join wages a on f.src = a.name and a.year = cast(f.time[1:4] as integer)
        left join wages b on f.dst = b.name and b.year = a.year group by all having sum(f.cnt) > 15""",
}


def _wages(t):
    from odflux.operators.setops import carry_forward_year

    return carry_forward_year(t.wage().where("year <= 2000"), 2000, 2001)


@query(
    "ana08_salary_difference",
    """select time, name, value, cnt, round(salary_diff_weighted, 3) as salary_diff_weighted,
              round(salary_diff_weighted / cnt, 4) as average_salary_diff from pay""",
    WAGES,
)
def _(t):
    out = income.salary_difference(t.typed_flow(), _wages(t), minimum=15)
    return rounded(rounded(out, 3, "salary_diff_weighted"), 4, "average_salary_diff")


@query(
    "ana08_salary_difference_without_self",
    """select f.time, f.src as name, f.value, sum(f.cnt)::bigint as cnt,
              round(sum(coalesce(b.wage - a.wage, 0) * f.cnt) / sum(f.cnt), 4) as average_salary_diff
       from typed_flow f join wages a on f.src = a.name and a.year = cast(f.time[1:4] as integer)
       left join wages b on f.dst = b.name and b.year = a.year where f.src <> f.dst group by all having sum(f.cnt) > 15""",
    WAGES,
)
def _(t):
    out = income.salary_difference(t.typed_flow(), _wages(t), self_edges=False, minimum=15)
    return rounded(out.drop("salary_diff_weighted"), 4, "average_salary_diff")


@query(
    "ana09_salary_difference_by_tier",
    """select value, time, tier, sum(cnt)::bigint as cnt, round(sum(salary_diff_weighted) / sum(cnt) / 1000, 6) as average_salary_diff,
              ['Tier 1', 'New tier 1', 'Tier 2', 'Tier 3', 'Tier 4', 'Tier 5'][tier + 1] as tier_name
       from pay join tiers using (name) where time like '%Q4' group by all""",
    WAGES,
)
def _(t):
    cities = income.salary_difference(t.typed_flow(), _wages(t), minimum=15)
    out = income.salary_difference_by_tier(cities, t.tiers(), quarter=4)
    return rounded(out.drop("salary_diff_weighted"), 6, "average_salary_diff")


# ---- demand ------------------------------------------------------------------------

JOBS = {"jobs": _category_sql(), "flow_names": "select distinct time, src as name from season_flow where src <> 'NATION_6' or time <> '1996Q3'"}


def _names(t):
    return t.flow().where("src <> 'NATION_6' or time <> '1996Q3'").select("time", F.col("src").alias("name")).distinct()


def _jobs(t):
    return materialize(category_sum(t.topic_count()), "jobs")


def _stack(categories, template, alias):
    return " union all ".join(template.format(c=c, a=alias) for c in categories)


@query(
    "ana10_demand_trend",
    "with j as (select time, name, * exclude (time, name) from flow_names left join jobs using (time, name) where time <= '1999Q4'),".replace("with j as", "select * from (with j as", 1)
    + " k as (select * from j where name in (select name from j group by name having count(distinct time) = (select count(distinct time) from j))) "
    + _stack(
        demand.TREND_CATEGORIES,
        """select tier, time, '{c}' as category, round(sum(coalesce("jd_{c}", 0)) / 1000, 6) as thousands from k join tiers using (name) group by all""",
        "",
    ) + ")",
    JOBS,
)
def _(t):
    return rounded(demand.demand_trend(_names(t), _jobs(t), t.tiers(), "1999Q4"), 6, "thousands")


@query(
    "ana11_tier_share",
    """select tier, time, 'Blue Collar' as category, round(sum("jd_Blue Collar") / sum(sum("jd_Blue Collar")) over (partition by time), 6) as occupation
       from jobs join tiers using (name) group by tier, time""",
    JOBS,
)
def _(t):
    return rounded(demand.tier_share(_jobs(t), t.tiers()), 6, "occupation")


@query(
    "ana12_occupation_shares",
    _stack(
        demand.OCCUPATIONS,
        """select tier, time, '{c}' as category, round(sum("jd_{c}") / sum("jd_Blue Collar"), 6) as occupation from jobs join tiers using (name) group by all
           union all select -1, time, '{c}', round(sum("jd_{c}") / sum("jd_Blue Collar"), 6) from jobs group by time""",
        "",
    ),
    JOBS,
)
def _(t):
    return rounded(demand.occupation_shares(_jobs(t), t.tiers()), 6, "occupation")


def _pick(c, time):
    return f"""sum(case when time = '{time}' then "jd_{c}" end)"""


_FIGURES = f"""{_pick('Blue Collar', '1996Q4')} as a, {_pick('Blue Collar', '1997Q4')} as b, {_pick('Blue Collar', '1998Q4')} as c,
    {_pick('Public Transit Staff', '1996Q4')} as pa, {_pick('Public Transit Staff', '1998Q4')} as pc,
    {_pick('Blue Collar', '1997Q1')} as e, {_pick('Blue Collar', '1997Q2')} as f"""


@query(
    "ana13_growth_statistics",
    f"with s as (select -1 as tier, {_FIGURES} from jobs union all select tier, {_FIGURES} from jobs join tiers using (name) group by tier) ".replace("with s as", "select * from (with s as", 1)
    + " union all ".join(
        f"select tier, '{n}' as statistic, round({e}, 6) as value from s"
        for n, e in {
            "growth": "b / a - 1", "later_ratio": "c / a", "part_later_ratio": "pc / a", "part_share": "pa / a", "recovery": "f / e - 1",
        }.items()
    ) + ")",
    JOBS,
)
def _(t):
    out = demand.growth_statistics(_jobs(t), t.tiers(), "1996Q4", "1997Q4", "1998Q4", ("1997Q1", "1997Q2"))
    return rounded(out, 6, "value")


@query(
    "ana14_topic_precision",
    """select name, count(label) as n, sum(label)::bigint as positives, round(sum(label) / count(label), 6) as precision
       from annotation where name <> 'de' group by name""",
)
def _(t):
    return rounded(demand.topic_precision(t.annotation(), "de"), 6, "precision")


@query(
    "ana14_topic_quality",
    """with c as (select name as p, case when label = 1 then name else 'en' end as t from annotation),
            k as (select t as cls from c union select p from c),
            m as (select cls, (select count(*) from c where t = cls and p = cls) as hit, (select count(*) from c where p = cls) as claimed,
                  (select count(*) from c where t = cls) as actual from k)
       select round(avg(case when claimed = 0 then 0 else hit / claimed end), 6) as precision,
              round(avg(case when actual = 0 then 0 else hit / actual end), 6) as recall,
              round(sum(hit) / sum(actual), 6) as accuracy from m""".replace("with c as", "select * from (with c as", 1) + ")",
)
def _(t):
    rows = t.annotation().withColumn("truth", F.when(F.col("label") == 1, F.col("name")).otherwise(F.lit("en")))
    return rounded(demand.topic_quality(rows, "truth", "name"), 6, "precision", "recall", "accuracy")


@query(
    "ana15_region_trend",
    _stack(
        demand.REGION_CATEGORIES,
        """select region, time, '{c}' as category, round(sum(coalesce("jd_{c}", 0)) / 1000, 6) as thousands
           from flow_names left join jobs using (time, name) join region_city using (name) where time <= '1999Q4' group by all""",
        "",
    ),
    JOBS,
)
def _(t):
    return rounded(demand.region_trend(_names(t), _jobs(t), t.region_city(), "1999Q4"), 6, "thousands")


@query(
    "ana15_region_occupations",
    _stack(
        demand.OCCUPATIONS,
        """select region, time, '{c}' as category, round(sum(coalesce("jd_{c}", 0)) / sum(coalesce("jd_Blue Collar", 0)), 6) as occupation
           from flow_names left join jobs using (time, name) join region_city using (name) where time <= '1999Q4' group by all""",
        "",
    ),
    JOBS,
)
def _(t):
    return rounded(demand.region_occupations(_names(t), _jobs(t), t.region_city(), "1999Q4"), 6, "occupation")


# ---- mismatch ------------------------------------------------------------------------

def _avg_rank(keys, score):
    return f"rank() over (partition by {keys} order by {score} desc) + (count(*) over (partition by {keys}, {score}) - 1) / 2"


MISMATCH = {
    **TYPED,
    "supply": """select time, name, value as type, round(flow_in * 1000 / sum(flow_in) over (partition by time)
                 - flow_out * 1000 / sum(flow_out) over (partition by time), 6) as s from typed_table""",
    "region_demand": f"""
        select time, region, type, cnt, ratio, {_avg_rank('time, region', 'ratio')} as rank
        from (select *, cnt / sum(cnt) over (partition by time, region) as ratio
              from (select time, region, type, sum(cnt)::bigint as cnt from demand join region_city using (name) group by all))
        where type <> 'PROMO'""",
    "region_supply": f"""
        select * from (select time, region, type, s, {_avg_rank('time, region', 's')} as rank
              from (select time, region, type, round(sum(s), 9) as s from supply join region_city using (name) group by all))
        where type <> 'PROMO'""",
    "city_demand": f"""
        select time, name, type, {_avg_rank('time, name', 'ratio')} as rank
        from (select *, cnt / sum(cnt) over (partition by time, name) as ratio from demand where time >= '1996Q4') where type <> 'PROMO'""",
    "city_supply": f"""
        select * from (select time, name, type, {_avg_rank('time, name', 's')} as rank from supply where time >= '1996Q4') where type <> 'PROMO'""",
    "city_pairs": """
        select time, name, d.rank as rd, s.rank as rs, abs(d.rank - s.rank) as m, greatest(d.rank - s.rank, 0) as dl, greatest(s.rank - d.rank, 0) as sl
        from city_demand d join city_supply s using (time, name, type)""",
    "city_mismatch": """
        select time, name, avg(m) as industry_mismatch, avg(dl) as industry_demand_lack, avg(sl) as industry_supply_lack,
               avg(case when rd <= 2 then m end) as industry_mismatch_dtop2, avg(case when rd <= 2 then dl end) as industry_demand_lack_dtop2,
               avg(case when rd <= 2 then sl end) as industry_supply_lack_dtop2, avg(case when rs <= 2 then m end) as industry_mismatch_stop2,
               avg(case when rs <= 2 then dl end) as industry_demand_lack_stop2, avg(case when rs <= 2 then sl end) as industry_supply_lack_stop2
        from city_pairs group by all""",
}
MISMATCH_COLUMNS = [
    f"industry_{c}{s}" for s in ("", "_dtop2", "_stop2") for c in ("mismatch", "demand_lack", "supply_lack")
]


def _supply(t):
    table = typed_centrality_table(t.typed_flow(), t.demand(), t.location(), pr_hits=False)
    score = F.round("flow_in_net_country_norm", 6).alias("flow_in_net_country_norm")
    return materialize(table.select("time", "name", F.col("value").alias("type"), score), "supply")


@query("ana16_demand_ranks", "select time, region, type, cnt, round(ratio, 6) as ratio, rank from region_demand", MISMATCH)
def _(t):
    ranks = mismatch.demand_ranks(t.demand().join(t.region_city(), "name"), "region", "PROMO")
    return rounded(ranks, 6, "ratio").select("time", "region", "type", "cnt", "ratio", "rank")


@query("ana16_supply_ranks", "select time, region, type, rank from region_supply", MISMATCH)
def _(t):
    ranks = mismatch.supply_ranks(_supply(t).join(t.region_city(), "name"), "region", "PROMO")
    return ranks.select("time", "region", "type", "rank")


@query(
    "ana17_city_mismatch",
    f"select time, name, {', '.join(f'round({c}, 6) as {c}' for c in MISMATCH_COLUMNS)} from city_mismatch",
    MISMATCH,
)
def _(t):
    out = mismatch.city_mismatch(t.demand(), _supply(t), "1996Q4", "PROMO", k=2)
    return rounded(out, 6, *MISMATCH_COLUMNS)


@query(
    "ana17_region_mismatch",
    f"""select time, region, {', '.join(f'round(avg({c}), 6) as {c}' for c in MISMATCH_COLUMNS)}
        from city_mismatch join region_city using (name) group by all""",
    MISMATCH,
)
def _(t):
    cities = mismatch.city_mismatch(t.demand(), _supply(t), "1996Q4", "PROMO", k=2)
    return rounded(mismatch.region_mismatch(cities, t.region_city()), 6, *MISMATCH_COLUMNS)


@query(
    "ana18_mismatch_words",
    """select time, region, type, d.rank as rank_demand, s.rank as rank_supply, d.rank - s.rank as rank_diff,
              abs(d.rank - s.rank) as weight, sign(d.rank - s.rank)::integer as sign
       from region_demand d join region_supply s using (time, region, type) where time in ('1996Q4', '1997Q4', '1998Q4')""",
    MISMATCH,
)
def _(t):
    return mismatch.mismatch_words(t.demand(), _supply(t), t.region_city(), TIMES, "PROMO")
