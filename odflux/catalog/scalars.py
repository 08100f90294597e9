"""Scalar functions on whole tables."""

from pyspark.sql import functions as F

from odflux.catalog.inputs import rounded
from odflux.catalog.registry import query
from odflux.functions import periods, scalars
from odflux.operators import text
from odflux.operators.places import normalize_place, normalize_province

WORDS = ["ring", "red", "bolt", "old"]


@query(
    "str01_contains_position",
    "select doc_id, contains(text, 'en ') as found, (instr(text, 'en ') - 1)::integer as position from documents",
)
def _(t):
    return t.documents.select(
        "doc_id", F.contains("text", F.lit("en ")).alias("found"), scalars.contains_position("text", "en ").alias("position")
    )


@query(
    "str02_find_keywords",
    """select p_partkey, list_aggregate(list_filter([case when contains(p_name, 'ring') then 0 end, case when contains(p_name, 'red') then 1 end,
       case when contains(p_name, 'bolt') then 2 end, case when contains(p_name, 'old') then 3 end], lambda x: x is not null),
       'string_agg', '|') as hits from part""",
)
def _(t):
    joined = F.concat_ws("|", scalars.find_keywords("p_name", WORDS).cast("array<string>"))
    return t.part.select("p_partkey", F.nullif(joined, F.lit("")).alias("hits"))


@query(
    "str03_join_query_title",
    "select event_id, replace(concat(event_type, ';;', props), ',', ' ') as text from events",
)
def _(t):
    return t.events.select("event_id", scalars.join_query_title("event_type", "props").alias("text"))


@query("str04_parse_point", "select event_id, round(x, 6) as x, round(y, 6) as y from log_event")
def _(t):
    point = F.concat(F.lit("("), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string"), F.lit(")"))
    parsed = t.log_event().select("event_id", scalars.parse_point(point).alias("p")).select("event_id", "p.x", "p.y")
    return rounded(parsed, 6, "x", "y")


@query(
    "str05_normalize_city",
    """select c_custkey, case when n_nationkey % 3 = 0 then concat('Official ', n_nationkey)
              when n_name in ('NATION_1', 'NATION_2', 'NATION_4') then concat(n_name, ' City') end as city
       from customer join nation on c_nationkey = n_nationkey""",
)
def _(t):
    aliases = t.nation.where("n_nationkey % 3 = 0").select(
        F.col("n_name").alias("alias"), F.concat(F.lit("Official "), F.col("n_nationkey").cast("string")).alias("official")
    )
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("city")
    )
    return normalize_place(rows, aliases, "city", {" City": ["NATION_1", "NATION_2", "NATION_4"]})


@query(
    "str05_normalize_province",
    """select o_orderkey, case o_custkey % 8 when 0 then '青海省' when 1 then '北京市' when 2 then '西藏自治区'
              when 3 then '宁夏回族自治区' when 4 then '新疆维吾尔自治区' when 5 then '广西壮族自治区' when 6 then '香港特别行政区' end as province
       from orders""",
)
def _(t):
    names = F.array(*[F.lit(n) for n in ("青海", "北京", "西藏", "宁夏", "新疆", "广西", "香港", "未知")])
    rows = t.orders.select("o_orderkey", F.get(names, (F.col("o_custkey") % 8).cast("int")).alias("province"))
    return normalize_province(rows, "province")


@query("str06_append_suffix", "select c_custkey, concat(c_name, '市') as name from customer")
def _(t):
    return t.customer.select("c_custkey", scalars.append_suffix("c_name", "市").alias("name"))


@query(
    "str07_string_helpers",
    """select c_custkey, split_part(c_name, '#', 2) as tail, substring(c_name, 1, 4) as head, concat_ws('-', c_mktsegment, c_nationkey) as joined,
       concat(upper(substring(c_mktsegment, 1, 1)), lower(substring(c_mktsegment, 2))) as titled, length(c_name)::integer as size,
       regexp_full_match(split_part(c_name, '#', 2), '[0-9]+') as digits from customer""",
)
def _(t):
    tail = F.split("c_name", "#")[1]
    return t.customer.select(
        "c_custkey", tail.alias("tail"), F.substring("c_name", 1, 4).alias("head"),
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("joined"),
        F.initcap("c_mktsegment").alias("titled"), F.length("c_name").alias("size"), scalars.is_digit(tail).alias("digits"),
    )


@query(
    "dat01_parse_compact_timestamp",
    """select event_id, year(ts)::integer as year, month(ts)::integer as month, day(ts)::integer as day, hour(ts)::integer as hour
       from events where event_id % 5 <> 0""",
)
def _(t):
    stamp = F.when(F.col("event_id") % 5 == 0, F.lit("20241399000000")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    parsed = t.events.select("event_id", periods.parse_compact_timestamp(stamp).alias("at")).na.drop()
    return periods.timestamp_parts(parsed, "at").drop("at")


@query(
    "dat02_period_labels",
    """select o_orderkey, strftime(o_orderdate, '%Y%m') as month, concat(year(o_orderdate), 'Q', quarter(o_orderdate)) as season,
              'all' as whole from orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey", periods.month_str("o_orderdate").alias("month"),
        periods.season_str("o_orderdate").alias("season"), periods.period_label("o_orderdate", "all").alias("whole"),
    )


@query(
    "dat04_period_to_date",
    """select distinct month, strftime(date_trunc('month', d), '%Y-%m-%d') as month_start,
              strftime(date_trunc('quarter', d), '%Y-%m-%d') as season_start, year(d)::integer as year
       from (select o_orderdate as d, strftime(o_orderdate, '%Y%m') as month from orders)""",
)
def _(t):
    labels = t.orders.select(
        periods.month_str("o_orderdate").alias("month"), periods.season_str("o_orderdate").alias("season")
    ).distinct()
    text_of = lambda c: F.date_format(periods.period_to_date(c), "yyyy-MM-dd")
    return labels.select(
        "month", text_of("month").alias("month_start"), text_of("season").alias("season_start"),
        periods.period_year("month").alias("year"),
    )


@query(
    "mat01_grid_id",
    """select event_id, cast(floor(cast(trunc(x - 2000) as bigint) / 300.0) * 100000
              + floor(cast(trunc(y - 500) as bigint) / 300.0) as bigint) as grid_id from log_event""",
)
def _(t):
    return t.log_event().select("event_id", scalars.grid_id(F.col("x") - 2000, F.col("y") - 500, 300).alias("grid_id"))


@query(
    "mat02_distances",
    """select time, src, dst, round(sqrt((a.mc_x - b.mc_x) ** 2 + (a.mc_y - b.mc_y) ** 2), 6) as euclid,
              (a.mc_x - b.mc_x) ** 2 + (a.mc_y - b.mc_y) ** 2 as squared
       from season_flow join place a on src = a.name join place b on dst = b.name""",
)
def _(t):
    end = lambda side: t.place().select(
        F.col("name").alias(side), F.col("mc_x").alias(f"{side}_x"), F.col("mc_y").alias(f"{side}_y")
    )
    joined = t.flow().join(end("src"), "src").join(end("dst"), "dst")
    four = ("src_x", "src_y", "dst_x", "dst_y")
    return joined.select(
        "time", "src", "dst", F.round(scalars.euclid(*four), 6).alias("euclid"),
        scalars.squared_distance(*four).alias("squared"),
    )


@query("mat03_smoothed_ratio", "select c_custkey, round((c_acctbal + 1e-9) / (c_nationkey + 1e-9), 2) as ratio from customer")
def _(t):
    return t.customer.select("c_custkey", F.round(scalars.smoothed_ratio("c_acctbal", "c_nationkey"), 2).alias("ratio"))


@query(
    "mat04_basic_math",
    """select c_custkey, abs(c_acctbal) as a, greatest(c_acctbal, 0) as g, least(c_acctbal, 0) as l, round(c_acctbal, 1) as r,
              round(ln(abs(c_acctbal) + 1), 6) as n, round(c_acctbal / 1000, 6) as k from customer""",
)
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey", F.abs(b).alias("a"), F.greatest(b, F.lit(0.0)).alias("g"), F.least(b, F.lit(0.0)).alias("l"),
        F.round(b, 1).alias("r"), F.round(F.log(F.abs(b) + 1), 6).alias("n"), F.round(b / 1000, 6).alias("k"),
    )


@query(
    "arr01_distinct_tokens",
    "select doc_id, coalesce(words, 0) as words from (select distinct doc_id from documents) left join (select doc_id, count(distinct word) as words from token group by doc_id) using (doc_id)",
)
def _(t):
    return t.post().select("doc_id", F.size(text.distinct_tokens("title")).cast("bigint").alias("words"))
