"""Place matching of whole search texts."""

from pyspark.sql import functions as F

from odflux.catalog.joins import CANDIDATES
from odflux.catalog.registry import query
from odflux.operators import places

CHOSEN = {
    **CANDIDATES,
    "asked": "select distinct text, x, y, province from search",
    "chosen": """
        select a.text, a.x, a.y, a.province,
               arg_min({'p': k.province, 'c': k.city, 'r': k.region},
                       (k.province <> a.province, k.level, k.original_level, (k.x - a.x) ** 2 + (k.y - a.y) ** 2,
                        k.province, k.city, k.region)) as best
        from asked a join kept k on a.text = k.text group by all""",
}


@query(
    "geo01_match_destination",
    """select s.userid, s.text, s.city, c.best.p as to_province, nullif(c.best.c, '') as to_city, nullif(c.best.r, '') as to_region
       from search s join chosen c on s.text = c.text and s.x = c.x and s.y = c.y and s.province = c.province""",
    CHOSEN,
)
def _(t):
    rows = t.search().select("userid", "text", "x", "y", "province", "city")
    return places.match_destination(rows, t.area()).select("userid", "text", "city", "to_province", "to_city", "to_region")


@query(
    "geo02_query_process",
    """select distinct cast(s.userid as varchar) as userid, year(event_time)::integer as year, month(event_time)::integer as month,
              day(event_time)::integer as day, 0 as hour, s.province as province_from, s.city as city_from,
              c.best.p as province_to, nullif(c.best.c, '') as city_to, s.text as query
       from search s join chosen c on s.text = c.text and s.x = c.x and s.y = c.y and s.province = c.province
       where (contains(s.query, 'red') or contains(s.query, 'ring') or contains(s.query, 'anvil'))
         and s.city not in ('NATION_3', 'NATION_8')""",
    CHOSEN,
)
def _(t):
    point = F.concat(F.lit("("), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string"), F.lit(")"))
    log = t.search().select(
        "query", point.alias("location"), "title", F.col("userid").cast("string").alias("userid"),
        F.date_format("event_time", "yyyyMMddHHmmss").alias("stamp"),
    )
    cell = lambda c: F.floor(F.col(c).cast("bigint") / 1.0)
    grid = t.place().where("name not in ('NATION_3', 'NATION_8')").select(
        (cell("mc_x") * 100000 + cell("mc_y")).alias("grid_id"), "province", F.col("name").alias("city")
    )
    return places.query_process(log, grid, t.area(), ["red", "ring", "anvil"], grid_length=1)
