"""Aggregates, ranks and statistics."""

from pyspark.sql import functions as F

from odflux.catalog.inputs import rounded
from odflux.catalog.registry import query
from odflux.functions import scalars
from odflux.graph.degree import end_flows
from odflux.operators import aggregates, ranking, stats
from odflux.plans.flows import grain_tables


@query("agg01_count_by", "select city_from, city_to, value, count(*) as cnt from trip group by all")
def _(t):
    return aggregates.count_by(t.trip(typed=True), "city_from", "city_to", "value")


@query("agg02_distinct_rows", "select distinct userid, city_to from trip")
def _(t):
    return aggregates.distinct_rows(t.trip(), "userid", "city_to")


@query(
    "agg03_user_day_od_count",
    """select strftime(event_date, '%Y-%m-%d') as event_date, province_from, city_from, province_to, city_to, cnt from daily_flow""",
)
def _(t):
    return t.daily_flow().withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))


@query("agg04_sum_by", "select time, type, sum(cnt)::bigint as cnt from demand group by all")
def _(t):
    return aggregates.sum_by(t.demand(), ["time", "type"], ["cnt"])


@query("agg05_mean_by", "select time, type, round(avg(cnt), 6) as cnt from demand group by all")
def _(t):
    return rounded(aggregates.mean_by(t.demand(), ["time", "type"], ["cnt"]), 6, "cnt")


@query(
    "agg06_count_sum_rate",
    """select name, count(label) as n, sum(label)::bigint as positives, round(sum(label) / count(label), 6) as precision
       from annotation where name <> 'es' group by name""",
)
def _(t):
    return rounded(aggregates.count_sum_rate(t.annotation(), "name", "label", "es"), 6, "precision")


@query(
    "agg07_global_stats",
    "select sum(cnt)::bigint as total, min(cnt) as minimum, max(cnt) as maximum, count(*) as n from season_flow",
)
def _(t):
    return aggregates.global_stats(t.flow(), "cnt")


def _category_sql():
    sums = [
        f"""sum(case when topic in ({', '.join(map(str, topics))}) then cnt else 0 end)::double as "jd_{name}" """
        for name, topics in aggregates.JOB_CATEGORIES.items()
    ]
    names = [f"jd_{n}" for n in aggregates.JOB_CATEGORIES]
    shares = [f'round("{n}" / sum("{n}") over (partition by time), 6) as "{n}_norm"' for n in names]
    quoted = ", ".join(f'"{n}"' for n in names)
    return f"""select time, name, {quoted}, {', '.join(shares)}
               from (select time, name, {', '.join(sums)} from topic_count group by all)"""


@query("agg08_category_sum", _category_sql())
def _(t):
    wide = aggregates.category_sum(t.topic_count())
    return rounded(wide, 6, *[c for c in wide.columns if c.endswith("_norm")])


def _category_rows():
    return ", ".join(f"('{c}', {k})" for c, topics in aggregates.JOB_CATEGORIES.items() for k in topics)


@query(
    "agg08_category_long",
    f"""select time, name, category, sum(cnt)::bigint as cnt from topic_count
        join (values {_category_rows()}) v(category, k) on topic = k group by all""",
)
def _(t):
    return aggregates.category_long(t.topic_count())


@query(
    "agg09_share_of_group",
    """select time, name, type, cnt, round(cnt / sum(cnt) over (partition by time, name), 6) as ratio from demand""",
)
def _(t):
    return rounded(aggregates.share_of_group(t.demand(), ["time", "name"]), 6, "ratio")


@query(
    "agg10_weighted_mean",
    "select city, round(sum(v * n) / sum(n), 6) as weighted_mean from (select n_name as city, c_acctbal as v, c_custkey % 17 + 1 as n from customer join nation on c_nationkey = n_nationkey) group by city",
)
def _(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("city"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 17 + 1).alias("n")
    )
    return rounded(aggregates.weighted_mean(rows, ["city"], "v", "n"), 6, "weighted_mean")


@query(
    "agg11_ratio_of_sums",
    """select tier, time, round(sum(case when topic = 18 then cnt else 0 end) / sum(case when topic < 9 then cnt else 0 end), 6) as a,
              round(sum(case when topic = 21 then cnt else 0 end) / sum(case when topic < 9 then cnt else 0 end), 6) as b
       from topic_count join tiers using (name) group by all""",
)
def _(t):
    pick = lambda test: F.when(test, F.col("cnt")).otherwise(0)
    topic = F.col("topic")
    rows = t.topic_count().join(t.tiers(), "name").select(
        "tier", "time", pick(topic == 18).alias("a"), pick(topic == 21).alias("b"), pick(topic < 9).alias("base")
    )
    return rounded(aggregates.ratio_of_sums(rows, ["tier", "time"], ["a", "b"], "base"), 6, "a", "b")


@query(
    "agg12_five_number_summary",
    """with b as (select time, quantile_cont(cnt, [0, 0.25, 0.5, 0.75, 1]) as q, count(*) as n from season_flow group by time)
       select time, n, q[1] as minimum, q[2] as q1, q[3] as median, q[4] as q3, q[5] as maximum,
              min(case when cnt >= q[2] - 1.5 * (q[4] - q[2]) and cnt <= q[4] + 1.5 * (q[4] - q[2]) then cnt end) as whisker_low,
              max(case when cnt >= q[2] - 1.5 * (q[4] - q[2]) and cnt <= q[4] + 1.5 * (q[4] - q[2]) then cnt end) as whisker_high
       from season_flow join b using (time) group by all""".replace("with b as", "select * from (with b as", 1) + ")",
)
def _(t):
    return ranking.five_number_summary(t.flow(), ["time"], "cnt")


@query(
    "agg12_five_number_summary_of_scores",
    """with r as (select tier, c_acctbal as v from customer join place on c_nationkey = place_key),
            b as (select tier, count(*) as n, quantile_cont(v, [0, 0.25, 0.5, 0.75, 1]) as q from r group by tier),
            s as (select b.*, v, v between q[2] - 1.5 * (q[4] - q[2]) and q[4] + 1.5 * (q[4] - q[2]) as inside from r join b using (tier))
       select tier, any_value(n) as n, round(any_value(q[1]), 6) as minimum, round(any_value(q[2]), 6) as q1,
              round(any_value(q[3]), 6) as median, round(any_value(q[4]), 6) as q3, round(any_value(q[5]), 6) as maximum,
              round(min(v) filter (inside), 6) as whisker_low, round(max(v) filter (inside), 6) as whisker_high
       from s group by tier""".replace("with r as", "select * from (with r as", 1) + ")",
)
def _(t):
    rows = t.customer.join(t.place(), F.col("c_nationkey") == F.col("place_key"))
    box = ranking.five_number_summary(rows, ["tier"], "c_acctbal")
    return rounded(box, 6, "minimum", "q1", "median", "q3", "maximum", "whisker_low", "whisker_high")


CORR = {
    "places": """
        select name, cast(i as double) as flow_in, cast(o as double) as flow_out, cast(i - o as double) as flow_in_net, gdp
        from (select name, sum(i) as i, sum(o) as o from (select dst as name, cnt as i, 0 as o from season_flow
              union all select src, 0, cnt from season_flow) group by name) join gdp using (name)""",
}
CORR_COLUMNS = ["flow_in", "flow_out", "flow_in_net"]


def _corr_rows(t):
    flows = end_flows(t.flow("all")).select("name", *[F.col(c).cast("double").alias(c) for c in ("flow_in", "flow_out")])
    return flows.withColumn("flow_in_net", F.col("flow_in") - F.col("flow_out")).join(t.gdp(), "name")


@query(
    "agg13_pearson",
    " union all ".join(f"select '{c}' as metric, round(corr({c}, gdp), 3) as coefficient from places" for c in CORR_COLUMNS),
    CORR,
)
def _(t):
    return stats.correlations(_corr_rows(t), CORR_COLUMNS, "gdp").select("metric", "coefficient")


def _rank_sql(c):
    return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2"


@query(
    "agg13_spearman",
    " union all ".join(
        f"select '{c}' as metric, round(corr(a, b), 3) as coefficient from (select {_rank_sql(c)} as a, {_rank_sql('gdp')} as b from places)"
        for c in CORR_COLUMNS
    ),
    CORR,
)
def _(t):
    return stats.correlations(_corr_rows(t), CORR_COLUMNS, "gdp", "spearman").select("metric", "coefficient")


@query(
    "agg13_kendall",
    " union all ".join(
        f"""select '{c}' as metric, round(sum(sign(a.{c} - b.{c}) * sign(a.gdp - b.gdp))
                   / sqrt(sum(abs(sign(a.{c} - b.{c}))) * sum(abs(sign(a.gdp - b.gdp)))), 3) as coefficient
            from places a cross join places b where a.name < b.name"""
        for c in CORR_COLUMNS
    ),
    CORR,
)
def _(t):
    return stats.correlations(_corr_rows(t), CORR_COLUMNS, "gdp", "kendall").select("metric", "coefficient")


# The t distribution with a whole number of degrees of freedom is a finite sum of powers of
# the cosine of its angle.
P_VALUE = """
    case when nu % 2 = 1 then 1 - 2 / pi() * (theta + case when nu > 1 then sin(theta) * list_sum([
             exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos(theta), 2 * k + 1) for k in range(0, (nu - 1) // 2)]) else 0 end)
         else 1 - sin(theta) * list_sum([
             exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos(theta), 2 * k) for k in range(0, nu // 2)]) end"""


@query(
    "agg13_p_values",
    f"""select metric, round({P_VALUE}, 5) as p_value from (
          select metric, nu, atan(abs(r) / sqrt(1 - r * r)) as theta from ("""
    + " union all ".join(f"select '{c}' as metric, corr({c}, gdp) as r, count({c} + gdp)::bigint - 2 as nu from places" for c in CORR_COLUMNS)
    + "))",
    CORR,
)
def _(t):
    return stats.correlations(_corr_rows(t), CORR_COLUMNS, "gdp").select("metric", "p_value")


@query(
    "agg14_zscore",
    """select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over (), 6) as c_acctbal from customer""",
)
def _(t):
    return rounded(stats.zscore(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]), 6, "c_acctbal")


@query(
    "agg15_macro_metrics",
    """with c as (select cast(label as varchar) as t, cast(label2 as varchar) as p from annotation),
            k as (select t as cls from c union select p from c),
            m as (select cls, (select count(*) from c where t = cls and p = cls) as hit, (select count(*) from c where p = cls) as claimed,
                  (select count(*) from c where t = cls) as actual from k)
       select round(avg(case when claimed = 0 then 0 else hit / claimed end), 6) as precision,
              round(avg(case when actual = 0 then 0 else hit / actual end), 6) as recall,
              round(sum(hit) / sum(actual), 6) as accuracy from m""".replace("with c as", "select * from (with c as", 1) + ")",
)
def _(t):
    return rounded(stats.macro_metrics(t.annotation(), "label", "label2"), 6, "precision", "recall", "accuracy")


@query(
    "agg16_present_in_all_periods",
    """select concat(src, dst) as name from season_flow where time in ('1996Q1', '1997Q1', '1998Q1', '1999Q1')
       group by all having count(distinct time) = 4""",
)
def _(t):
    pairs = t.flow().withColumn("name", F.concat("src", "dst"))
    return aggregates.present_in_all_periods(pairs, ["1996Q1", "1997Q1", "1998Q1", "1999Q1"])


DEGREE = {
    "deg": """select time, name, sum(i)::bigint as flow_in, sum(o)::bigint as flow_out from (select time, dst as name, cnt as i, 0 as o
              from season_flow union all select time, src, 0, cnt from season_flow) group by all""",
}


@query(
    "agg17_per_mille_norm",
    """select time, name, flow_in, flow_out, round(flow_in * 1000 / sum(flow_in) over (partition by time), 6) as flow_in_country_norm,
              round(flow_out * 1000 / sum(flow_out) over (partition by time), 6) as flow_out_country_norm,
              round(flow_in * 1000 / sum(flow_in) over (partition by time) - flow_out * 1000 / sum(flow_out) over (partition by time), 6)
                + 0 as flow_in_net_country_norm from deg""",
    DEGREE,
)
def _(t):
    out = aggregates.per_mille_norm(end_flows(t.flow()), ["flow_in", "flow_out"])
    return rounded(out, 6, *[c for c in out.columns if c.endswith("_norm")])


@query(
    "agg17_per_mille_norm_by_name",
    """select time, name, type, cnt, round(cnt * 1000 / sum(cnt) over (partition by time, name), 6) as cnt_name_norm from demand""",
)
def _(t):
    return rounded(aggregates.per_mille_norm(t.demand(), ["cnt"], "name"), 6, "cnt_name_norm")


@query(
    "agg18_flow_norm_with_self",
    """select time, name, round(flow_in / total, 6) as flow_in_norm_with_selfflow, round(flow_out / total, 6) as flow_out_norm_with_selfflow,
              round((flow_in - flow_out) / total, 6) as flow_in_net_norm_with_selfflow
       from (select time, name, sum(i) as flow_in, sum(o) as flow_out from (select time, dst as name, cnt as i, 0 as o from season_edges
             union all select time, src, 0, cnt from season_edges) group by all)
       join (select time, sum(cnt) as total from season_flow group by all) using (time)""",
)
def _(t):
    from odflux.graph.degree import degrees

    out = aggregates.flow_norm_with_self(degrees(t.edges()), t.flow())
    names = [c for c in out.columns if c.endswith("selfflow")]
    return rounded(out.select("time", "name", *names), 6, *names)


@query(
    "agg19_array_sum_by",
    """select label, pos::integer as pos, round(sum(x), 4) as total
       from (select label, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding)::double as x from embeddings) group by all""",
)
def _(t):
    vectors = t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("v"))
    summed = aggregates.array_sum_by(vectors, ["label"], "v")
    return summed.select("label", F.posexplode("v").alias("p", "x")).select(
        "label", (F.col("p") + 1).alias("pos"), F.round("x", 4).alias("total")
    )


@query(
    "agg19_sparse_to_dense",
    """select o_orderkey, case when o_custkey % 5 = o_orderkey % 5 then 3.0 when o_custkey % 5 = 0 then 1.0
              when o_orderkey % 5 = 0 then 2.0 else 0.0 end::double as first,
              case when o_custkey % 5 = o_orderkey % 5 and o_custkey % 5 <> 0 then 0.0::double
                   when o_custkey % 5 = o_orderkey % 5 then 3.0::double when o_custkey % 5 = 0 then 1.0::double
                   when o_orderkey % 5 = 0 then 2.0::double else 0.0::double end as at_zero from orders""",
)
def _(t):
    a, b = (F.col("o_custkey") % 5).cast("int"), (F.col("o_orderkey") % 5).cast("int")
    rows = t.orders.select("o_orderkey", "o_custkey", F.array(a, b).alias("i"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    dense = rows.withColumn("d", aggregates.sparse_to_dense("i", "v", 5))
    at_zero = F.col("d")[0]
    same = F.col("i")[0] == F.col("i")[1]
    return dense.select(
        "o_orderkey", F.when(same, F.col("d")[F.col("i")[0]]).otherwise(at_zero).alias("first"), at_zero.alias("at_zero")
    )


@query(
    "agg20_pivot_wide",
    """select src, max(case when time = '1996Q1' then cnt end) as "1996Q1", max(case when time = '1996Q2' then cnt end) as "1996Q2"
       from (select src, time, sum(cnt)::bigint as cnt from season_flow group by all) group by src""",
)
def _(t):
    out = t.flow().groupBy("src", "time").agg(F.sum("cnt").alias("cnt"))
    return aggregates.pivot_wide(out, "src", "time", ["1996Q1", "1996Q2"], "cnt")


@query(
    "agg21_unpivot_long",
    """select time, name, 'flow_in' as metric, flow_in as value from deg union all select time, name, 'flow_out', flow_out from deg""",
    DEGREE,
)
def _(t):
    return aggregates.unpivot_long(end_flows(t.flow()), ["time", "name"], ["flow_in", "flow_out"])


def _grain_sql():
    label = {"month": "strftime(event_date, '%Y%m')", "season": "concat(year(event_date), 'Q', quarter(event_date))", "all": "'all'"}
    return " union all ".join(
        f"""select '{g}' as grain, '{c}' as coarse, {label[g]} as time, {c}_from as src, {c}_to as dst,
                   sum(cnt)::bigint as cnt from daily_flow group by all"""
        for g in label for c in ("province", "city")
    )


@query("agg22_multi_grain_rollup", _grain_sql())
def _(t):
    return aggregates.multi_grain_rollup(t.daily_flow())


@query(
    "ana01_transition_tables",
    f"""select * from ({_grain_sql().replace('from daily_flow', "from (select * from daily_flow where event_date between date '1996-04-01' and date '1997-11-30')")})
        where src <> dst and src not in ('NATION_9', 'ASIA') and dst not in ('NATION_9', 'ASIA')""",
)
def _(t):
    daily = t.daily_flow()
    for c in ("city_from", "city_to"):
        daily = daily.withColumn(c, F.when(F.col(c) == "NATION_9", "NuLL").otherwise(F.col(c)))
    for c in ("province_from", "province_to"):
        daily = daily.withColumn(c, F.when(F.col(c) == "ASIA", "NuLL").otherwise(F.col(c)))
    return grain_tables(daily, (1996, 4), (1997, 11))


# ---- ranks and growth --------------------------------------------------------

@query(
    "win01_average_rank_desc",
    """select time, name, type, cnt, rank() over (partition by time, name order by cnt desc)
              + (count(*) over (partition by time, name, cnt) - 1) / 2 as rank from demand""",
)
def _(t):
    return ranking.average_rank_desc(t.demand(), ["time", "name"], "cnt").select("time", "name", "type", "cnt", "rank")


@query(
    "win01_average_rank_of_all_customers",
    """select c_custkey, rank() over (order by c_acctbal desc) + (count(*) over (partition by c_acctbal) - 1) / 2 as rank from customer""",
)
def _(t):
    return ranking.average_rank_desc(t.customer.select("c_custkey", "c_acctbal"), [], "c_acctbal").select("c_custkey", "rank")


@query(
    "win02_top_n_ranking",
    """select name, flow_in, (row_number() over (order by flow_in desc, name))::integer as rank from deg where time = '1997Q2'
       order by flow_in desc, name limit 12""",
    DEGREE,
)
def _(t):
    return ranking.top_n_ranking(end_flows(t.flow()), "flow_in", "1997Q2", 12)


@query(
    "win03_rank_mismatch",
    """select time, name, abs(a - b) as mismatch, greatest(a - b, 0) as demand_lack, greatest(b - a, 0) as supply_lack
       from (select time, name, rank() over (partition by time order by flow_in desc) + (count(*) over (partition by time, flow_in) - 1) / 2 as a,
             rank() over (partition by time order by flow_out desc) + (count(*) over (partition by time, flow_out) - 1) / 2 as b from deg)""",
    DEGREE,
)
def _(t):
    flows = end_flows(t.flow())
    ranked = ranking.average_rank_desc(flows, ["time"], "flow_in", "rank_demand")
    ranked = ranking.average_rank_desc(ranked, ["time"], "flow_out", "rank_supply")
    return ranking.rank_mismatch(ranked).select("time", "name", "mismatch", "demand_lack", "supply_lack")


WIDE = {
    "wide": """select concat(src, '>', dst) as pair, sum(case when time = '1996Q1' then cnt end) as a, sum(case when time = '1997Q1' then cnt end) as b,
                      sum(case when time = '1996Q4' then cnt end) as ta, sum(case when time = '1997Q4' then cnt end) as tb
               from season_flow group by all having count(case when time in ('1996Q1', '1997Q1', '1996Q4', '1997Q4') then 1 end) = 4""",
}


def _wide(t):
    from odflux.operators.joins import compare_periods

    flow = t.flow().withColumn("pair", F.concat("src", F.lit(">"), "dst"))
    wide = compare_periods(flow, "pair", "cnt", ["1996Q1", "1997Q1", "1996Q4", "1997Q4"])
    return wide.toDF("pair", "a", "b", "ta", "tb")


@query(
    "win05_growth",
    """select pair, round((b - a) / a, 6) as change, round(((b - a) / a - (tb - ta) / ta) / nullif((tb - ta) / ta, 0), 6) as second
       from wide""",
    WIDE,
)
def _(t):
    w = _wide(t).withColumn("change", scalars.growth("b", "a")).withColumn("trend", scalars.growth("tb", "ta"))
    return rounded(w.withColumn("second", scalars.growth("change", "trend")).select("pair", "change", "second"), 6, "change", "second")


@query(
    "win06_guarded_growth",
    """select pair, round(case when a > 0.001 * total then (b - a) / a else 0 end, 6) as change,
              round(case when abs(a - 4) > 2 then ((b - 4) - (a - 4)) / abs(a - 4) else 0 end, 6) as salary
       from wide cross join (select sum(a) as total from wide)""",
    WIDE,
)
def _(t):
    w = _wide(t)
    w = aggregates.attach(w, w.agg(F.sum("a").alias("total")), [])
    salary = scalars.guarded_salary_growth(F.col("b") - 4, F.col("a") - 4, 2)
    out = w.select("pair", scalars.guarded_growth("b", "a", 0.001, "total").alias("change"), salary.alias("salary"))
    return rounded(out, 6, "change", "salary")


@query(
    "win07_seasonally_adjusted_change",
    """select pair, round(case when a > 0.001 * total then b / a * (case when ta > 0 then tb / ta else 0 end) - 1 else 0 end, 6) as change
       from wide cross join (select sum(a) as total from wide)""",
    WIDE,
)
def _(t):
    w = _wide(t)
    w = aggregates.attach(w, w.agg(F.sum("a").alias("total")), [])
    change = scalars.seasonally_adjusted_change("b", "a", "tb", "ta", 0.001, "total")
    return rounded(w.select("pair", change.alias("change")), 6, "change")
