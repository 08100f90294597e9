"""Joins."""

from pyspark.sql import functions as F

from odflux.catalog.inputs import rounded
from odflux.catalog.registry import query
from odflux.operators import joins, places
from odflux.operators.nearest import nearest_place


@query(
    "joi01_grid_lookup",
    """select e.event_id, g.province, g.city from log_event e join grid g on g.grid_id =
       cast(floor(cast(trunc(x) as bigint) / 500.0) * 100000 + floor(cast(trunc(y) as bigint) / 500.0) as bigint)""",
)
def _(t):
    return joins.grid_lookup(t.log_event(), t.grid(), 500).select("event_id", "province", "city")


@query("joi02_lookup_default", "select time, src, dst, cnt, tier from season_flow join tiers on src = name")
def _(t):
    return joins.lookup_default(t.flow(), t.tiers(), "src", "tier")


@query(
    "joi02_lookup_default_kept",
    "select time, src, dst, cnt, coalesce(tier, -1)::integer as tier from season_flow left join tiers on src = name",
)
def _(t):
    return joins.lookup_default(t.flow(), t.tiers(), "src", "tier", keep=True)


@query(
    "joi03_lookup_strict",
    "select time, src, dst, cnt, concat('Place ', place_key) as en_name from season_flow join place on src = name",
)
def _(t):
    return joins.lookup_strict(t.flow(), t.translation(), "src", "en_name")


@query(
    "joi04_inner_join",
    """select a.time, a.src, a.dst, a.cnt as cnt_now, b.cnt as cnt_back from season_edges a
       join season_edges b on a.time = b.time and a.src = b.dst and a.dst = b.src""",
)
def _(t):
    back = t.edges().select("time", F.col("dst").alias("src"), F.col("src").alias("dst"), "cnt")
    return joins.inner_join(t.edges(), back, ["time", "src", "dst"], ("_now", "_back"))


_PRE = "(select src, dst, sum(cnt)::bigint as pre from season_flow where time < '1997Q1' group by all)"
_POST = "(select src, dst, sum(cnt)::bigint as post from season_flow where time >= '1997Q1' group by all)"


def _two(t):
    flow = t.flow()
    pre = flow.where("time < '1997Q1'").groupBy("src", "dst").agg(F.sum("cnt").alias("pre"))
    post = flow.where("time >= '1997Q1'").groupBy("src", "dst").agg(F.sum("cnt").alias("post"))
    return pre, post


@query(
    "joi05_full_outer_fill",
    f"select src, dst, coalesce(pre, 0) as pre, coalesce(post, 0) as post from {_PRE} full join {_POST} using (src, dst)",
)
def _(t):
    return joins.full_outer_fill(*_two(t), ["src", "dst"])


@query("joi06_left_join_fill", f"select src, dst, pre, coalesce(post, 0) as post from {_PRE} left join {_POST} using (src, dst)")
def _(t):
    return joins.left_join_fill(*_two(t), ["src", "dst"])



@query(
    "joi07_join_on_year_and_city",
    """select f.time, f.src, f.dst, f.cnt, a.year, round(coalesce(b.wage - a.wage, 0), 6) as wage_diff
       from season_flow f join wage a on f.src = a.name and a.year = cast(substring(f.time, 1, 4) as integer)
       left join wage b on f.dst = b.name and b.year = a.year and b.name in (select name from tiers)
       where f.src in (select name from tiers)""",
)
def _(t):
    stats = t.wage().join(t.tiers().select("name"), "name", "left_semi")
    edges = t.flow().withColumn("year", F.substring("time", 1, 4).cast("int"))
    joined = joins.join_on_year_and_city(edges, stats)
    return rounded(joined, 6, "wage_diff").select("time", "src", "dst", "cnt", "year", "wage_diff")


@query(
    "joi08_compare_periods",
    """select concat(src, dst) as pair, max(case when time = '1996Q1' then cnt end) as "1996Q1",
              max(case when time = '1997Q1' then cnt end) as "1997Q1", max(case when time = '1998Q1' then cnt end) as "1998Q1"
       from season_flow where time in ('1996Q1', '1997Q1', '1998Q1') group by all having count(*) = 3""",
)
def _(t):
    return joins.compare_periods(
        t.flow().withColumn("pair", F.concat("src", "dst")), "pair", "cnt", ["1996Q1", "1997Q1", "1998Q1"]
    )


@query(
    "joi09_dictionary_match",
    """select text, word from (select distinct text from search) join (select distinct word from area) on contains(text, word)""",
)
def _(t):
    return places.dictionary_match(t.search(), t.area())


@query(
    "joi09_dictionary_match_documents",
    """select doc_id, sum((length(text) - length(replace(text, word, ''))) // length(word))::bigint as hits, count(*) as words
       from documents join (select distinct lang as word from documents union select distinct substring(source, 1, 3) from documents
            union select distinct concat(lang, ' ') from documents union select 'the thing') on contains(text, word) group by doc_id""",
)
def _(t):
    lang = t.documents.select(F.col("lang").alias("word"))
    words = lang.union(t.documents.select(F.substring("source", 1, 3))).union(lang.select(F.concat("word", F.lit(" "))))
    words = words.union(t.spark.createDataFrame([("the thing",)], "word string")).distinct()
    hits = places.dictionary_match(t.documents, words, with_index=True, by_id=True)
    per_word = hits.groupBy("text_id", "word").agg(F.count("*").alias("n"))
    per_text = per_word.groupBy("text_id").agg(F.sum("n").alias("hits"), F.count("*").alias("words"))
    return t.documents.select("doc_id", F.md5("text").alias("text_id")).join(per_text, "text_id").drop("text_id")


@query(
    "joi09_dictionary_positions",
    """select text, word, pos - 1 as start, pos - 1 + length(word) as "end" from (
           select text, word, unnest(range(1, length(text)::bigint + 1)) as pos
           from (select distinct text from search) cross join (select distinct word from area))
       where substring(text, pos, length(word)) = word""",
)
def _(t):
    hits = places.dictionary_match(t.search(), t.area(), with_index=True)
    return hits.withColumns({"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")})


LONGEST = """
    select text, word from m where not exists
    (select 1 from m b where b.text = m.text and b.word <> m.word and contains(b.word, m.word))"""
MATCHED = {"m": "select text, word from (select distinct text from search) join (select distinct word from area) on contains(text, word)"}


@query("joi10_keep_longest_matches", LONGEST, MATCHED)
def _(t):
    words = t.area().select("word").distinct()
    return places.keep_longest_matches(places.dictionary_match(t.search(), words), words)


CANDIDATES = {
    **MATCHED,
    "longest": LONGEST,
    "merged": """select text, province, coalesce(city, '') as city, coalesce(region, '') as region, min(level) as level,
                        min(original_level) as original_level, arg_min(x, (x, y)) as x, arg_min(y, (x, y)) as y
                 from longest join area using (word) group by all""",
    "covers": """select s.text, s.province, s.city, s.region, w.province as wp, w.city as wc, w.region as wr, w.level as wlevel
                 from merged s join merged w on s.text = w.text and s.province = w.province
                      and (w.city = '' or w.city = s.city) and (w.region = '' or w.region = s.region)
                      and (s.city, s.region) <> (w.city, w.region)""",
    "kept": """select k.text, k.province, k.city, k.region, least(k.level, any_value(c.wlevel), min(c.wlevel)) as level,
                      k.original_level, k.x, k.y
               from merged k left join covers c on c.text = k.text and c.province = k.province and c.city = k.city and c.region = k.region
               where not exists (select 1 from covers d where d.text = k.text and d.wp = k.province and d.wc = k.city and d.wr = k.region)
               group by k.text, k.province, k.city, k.region, k.level, k.original_level, k.x, k.y""",
}
CANDIDATES["kept"] = CANDIDATES["kept"].replace("least(k.level, any_value(c.wlevel), min(c.wlevel))", "least(k.level, coalesce(min(c.wlevel), k.level))")


@query(
    "joi11_drop_covering_areas",
    "select text, province, nullif(city, '') as city, nullif(region, '') as region, level, original_level from kept",
    CANDIDATES,
)
def _(t):
    return places.text_candidates(t.search(), t.area()).drop("x", "y")


@query(
    "joi12_near_pairs",
    """select a.name as name_a, b.name as name_b, round(sqrt((a.mc_x - b.mc_x) ** 2 + (a.mc_y - b.mc_y) ** 2), 6) as distance
       from place a cross join place b where sqrt((a.mc_x - b.mc_x) ** 2 + (a.mc_y - b.mc_y) ** 2) < 60""",
)
def _(t):
    return rounded(joins.near_pairs(t.place(), 60.0), 6, "distance")


@query(
    "joi12_edge_distances",
    """select time, src, dst, cnt, round(sqrt((a.mc_x - b.mc_x) ** 2 + (a.mc_y - b.mc_y) ** 2), 6) as distance
       from season_flow join place a on src = a.name join place b on dst = b.name""",
)
def _(t):
    return rounded(joins.edge_distances(t.flow(), t.place()), 6, "distance")


@query(
    "joi12_find_near",
    """select a.name as name_a, b.name as name_b, round(sqrt((a.mc_x - b.mc_x) ** 2 + (a.mc_y - b.mc_y) ** 2), 6) as distance
       from place a cross join place b where a.province = 'ASIA' and sqrt((a.mc_x - b.mc_x) ** 2 + (a.mc_y - b.mc_y) ** 2) < 30""",
)
def _(t):
    seeds = t.place().where("province = 'ASIA'")
    return rounded(joins.find_near(t.place(), seeds, 30.0), 6, "distance")


@query(
    "joi13_nearest_place",
    """select event_id, name, round(d2, 4) as d2 from (
           select event_id, name, px, py, (x - px) * (x - px) + (y - py) * (y - py) as d2
           from log_event cross join (select name, mc_x * 40 as px, mc_y * 10 as py from place))
       qualify row_number() over (partition by event_id order by d2, name) = 1""",
)
def _(t):
    place = t.place().select("name", (F.col("mc_x") * 40).alias("px"), (F.col("mc_y") * 10).alias("py"))
    found = nearest_place(t.log_event().select("event_id", "x", "y"), place, ("x", "y"), ("px", "py"), ["name"])
    return rounded(found.select("event_id", "name", "d2"), 4, "d2")


@query(
    "joi13_nearest_candidate",
    """select event_id, arg_min(name, (round((x - mc_x * 40) ** 2 + (y - mc_y * 10) ** 2, 4), name)) as name
       from log_event join place on place_key % 5 = event_id % 5 group by event_id""",
)
def _(t):
    place = t.place().select("name", "place_key", (F.col("mc_x") * 40).alias("px"), (F.col("mc_y") * 10).alias("py"))
    pairs = t.log_event().join(place, F.col("event_id") % 5 == F.col("place_key") % 5)
    pairs = pairs.select("event_id", "x", "y", "name", "px", "py")
    return joins.nearest_candidate(pairs, ["event_id"], "x", "y", "px", "py", ["name"]).select("event_id", "name")
