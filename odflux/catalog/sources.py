"""Scans and sinks: data the tables give is written, read back and compared."""

from pyspark.sql import functions as F

from odflux.catalog.inputs import rounded
from odflux.catalog.registry import query
from odflux.functions import periods
from odflux.operators import aggregates
from odflux.schemas import TRIPS
from odflux.sources import files
from odflux.sources.dataset import Catalog, dataset


def write_log(t) -> str:
    """The events as a tab-separated log with 15 positions."""
    path = t.path("log")
    log = t.log_event()
    blank = F.lit("")
    point = F.concat(F.lit("("), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string"), F.lit(")"))
    stamp = F.date_format("event_time", "yyyyMMddHHmmss")
    broken_stamp = F.when(F.col("event_id") % 7 == 0, F.lit("soon")).otherwise(stamp)
    broken_point = F.when(F.col("event_id") % 11 == 0, F.lit("(x)")).otherwise(point)
    parts = [F.col("query"), blank, broken_point, blank, F.col("title"), F.col("userid"), *[blank] * 7, broken_stamp, blank]
    log.select(F.concat_ws("\t", *parts)).write.text(path)
    return path


@query(
    "src01_scan_event_log",
    """select query, case when event_id % 11 = 0 then '(x)' else concat('(', x, ', ', y, ')') end as location, title,
              userid, case when event_id % 7 = 0 then 'soon' else strftime(event_time, '%Y%m%d%H%M%S') end as stamp
       from log_event""",
)
def _(t):
    return files.scan_event_log(t.spark, write_log(t))


@query(
    "src02_scan_posts",
    """select doc_id, city, startdate from post
       where startdate like '2019-1%' or startdate like '2020%' or startdate like '2021%'""",
)
def _(t):
    path = t.path("posts")
    t.post().write.parquet(path)
    return files.scan_posts(t.spark.read.parquet(path), ["doc_id", "city", "startdate"], ["2019-1", "2020", "2021"])


@query(
    "src03_scan_transitions",
    """select strftime(event_date, '%Y%m') as month, city_from, city_to, cast(sum(cnt) as bigint) as cnt from daily_flow
       where event_date between date '1996-03-01' and date '1998-06-30' group by all""",
)
def _(t):
    path = t.path("transitions")
    files.write_transitions(t.daily_flow(), path)
    months = files.scan_transitions(t.spark, path, (1996, 3), (1998, 6))
    return aggregates.sum_by(months, ["month", "city_from", "city_to"], ["cnt"])


@query(
    "src03_scan_daily_csv",
    """select strftime(event_date, '%Y-%m-%d') as day, province_from, city_from, province_to, city_to, cnt from daily_flow""",
)
def _(t):
    path = t.path("daily")
    daily = t.daily_flow().select(
        F.date_format("event_date", "yyyy-M-d").alias("time"),
        "province_from", "city_from", "province_to", "city_to", F.col("cnt").alias("count"),
    )
    files.write_result(daily, path, "csv")
    read = files.scan_daily_csv(t.spark, path)
    return read.withColumn("day", F.date_format("event_date", "yyyy-MM-dd")).drop("event_date")


def _with_sentinel(column):
    return F.when(F.col(column) == "NATION_24", files.SENTINEL).otherwise(F.col(column))


@query(
    "src04_scan_flow_graph",
    "select time, src, dst, cnt from season_flow where src <> dst and src <> 'NATION_24' and dst <> 'NATION_24'",
)
def _(t):
    path = t.path("graph")
    graph = t.flow().select(
        "time", _with_sentinel("src").alias("from"), _with_sentinel("dst").alias("to"), F.col("cnt").alias("count")
    )
    files.write_result(graph, path, "csv")
    return files.scan_flow_graph(t.spark, path)


@query(
    "src04_scan_typed_graph",
    """select time, value, src, dst, cast(sum(cnt) as bigint) as cnt from typed_flow
       where src <> 'NATION_24' and dst <> 'NATION_24' group by all""",
)
def _(t):
    path = t.path("typed")
    typed = t.typed_flow().select(
        "time", F.lit("p").alias("province_from"), _with_sentinel("src").alias("city_from"),
        F.lit("p").alias("province_to"), _with_sentinel("dst").alias("city_to"), "value", F.col("cnt").alias("count"),
    )
    files.write_result(typed, path, "csv")
    return files.scan_typed_graph(t.spark, path, "city", self_edge=True)


def _csv(t, df, name):
    path = t.path(name)
    files.write_result(df, path, "csv")
    return path


@query("src05_scan_tier", "select name, tier from tiers")
def _(t):
    table = t.tiers().select(F.col("name").alias("city"), F.col("tier").alias("level"))
    return files.scan_tier(t.spark, _csv(t, table, "tier"))


@query("src05_scan_translation", "select name, concat('Place ', place_key) as en_name from place")
def _(t):
    return files.scan_translation(t.spark, _csv(t, t.translation(), "translation"))


@query(
    "src05_scan_location",
    """select name, round(ll_x, 6) as ll_x, round(ll_y, 6) as ll_y, round(mc_x / 1000, 6) as mc_x,
              round(mc_y / 1000, 6) as mc_y from location""",
)
def _(t):
    ll = _csv(t, t.location().select("name", "ll_x", "ll_y"), "ll")
    mc = _csv(t, t.location().select("name", "mc_x", "mc_y"), "mc")
    return rounded(files.scan_location(t.spark, ll, mc), 6, "ll_x", "ll_y", "mc_x", "mc_y")


@query("src05_scan_areas", "select name as city, province from place where name <> 'NATION_24'")
def _(t):
    areas = t.place().select(_with_sentinel("name").alias("city"), "province")
    return files.scan_areas(t.spark, _csv(t, areas, "areas"))


@query("src05_scan_gdp", "select name, round(gdp, 4) as gdp from gdp join place using (name) where place_key % 6 <> 1")
def _(t):
    known = t.gdp().join(t.place().select("name", "place_key"), "name")
    table = known.select("name", F.when(F.col("place_key") % 6 != 1, F.col("gdp")).alias("gdp"))
    return rounded(files.scan_gdp(t.spark, _csv(t, table, "gdp")), 4, "gdp")


@query("src05_scan_city_statistics", "select year, name, round(wage, 4) as wage from wage")
def _(t):
    table = t.wage().select("year", "name", "wage")
    return rounded(files.scan_city_statistics(t.spark, _csv(t, table, "wage")), 4, "wage")


@query(
    "src06_scan_geojson_centers",
    "select name, mc_x as center_x, mc_y as center_y from place where place_key <> 3",
)
def _(t):
    path = t.path("geojson")
    feature = F.struct(
        F.struct(
            F.when(F.col("place_key") == 3, F.lit("")).otherwise(F.col("name")).alias("name"),
            F.array("mc_x", "mc_y").alias("center"),
        ).alias("properties")
    )
    # One document per province.
    documents = t.place().groupBy("province").agg(F.collect_list(feature).alias("features"))
    documents.select("province", F.to_json(F.struct("features")).alias("value")).write.partitionBy("province").text(path)
    return files.scan_geojson_centers(t.spark, f"{path}/*")


@query("src07_scan_area_dictionary", "select word, province, city, level, original_level from area where level <= 1")
def _(t):
    path = t.path("areas")
    filled = t.area().na.fill(files.SENTINEL, ["city", "region"])
    filled.write.parquet(path)
    return files.scan_area_dictionary(t.spark, path, "city").select("word", "province", "city", "level", "original_level")


@query("src07_scan_grid_dictionary", "select grid_id, province, city from grid")
def _(t):
    path = t.path("grid")
    t.grid().write.parquet(path)
    return files.scan_grid_dictionary(t.spark, path)


@query(
    "src08_write_partitioned_csv",
    """select year(event_date)::integer as year, month(event_date)::integer as month, city_from, city_to, count(*) as cnt
       from trip group by all""",
)
def _(t):
    path = t.path("trips")
    trips = t.trip().select(
        F.col("userid").cast("string").alias("userid"), F.year("event_date").alias("year"),
        F.month("event_date").alias("month"), F.dayofmonth("event_date").alias("day"), F.lit(0).alias("hour"),
        "province_from", "city_from", "province_to", "city_to", F.lit("q").alias("query"),
    )
    files.write_partitioned_csv(trips, path, 16)
    read = t.spark.read.schema(TRIPS).csv(path)
    return aggregates.count_by(read, "year", "month", "city_from", "city_to")


@query("src09_write_result", "select time, src, dst, cnt from month_flow")
def _(t):
    path = t.path("result")
    files.write_result(t.flow("month"), path, partition_by=["time"])
    return t.spark.read.schema("src string, dst string, cnt bigint, time string").parquet(path)


@query(
    "src10_dataset",
    """with c as (select time, name, cast(sum(i) as bigint) as flow_in
                  from (select time, dst as name, cnt as i from season_flow union all select time, src, 0 from season_flow)
                  group by all),
            d as (select time, name, sum(cnt)::double as jd_all from topic_count group by all)
       select time, name, flow_in, coalesce(jd_all, 0) as jd_all from c left join d using (time, name)
       where time in (select time from season_flow where src <> dst)""".replace("with c as", "select * from (with c as", 1)
    + ")",
)
def _(t):
    from odflux.graph.degree import end_flows
    from odflux.session import materialize

    flow = materialize(t.flow(), "season")
    jobs = t.topic_count().groupBy("time", "name").agg(F.sum("cnt").cast("double").alias("jd_all"))
    catalog = Catalog()
    catalog.add("season", "city", dataset(flow, end_flows(flow).select("time", "name", "flow_in"), jobs, t.season_label()))
    data = catalog.get("season", "city")
    return data.centrality.join(data.times, "time", "left_semi")


@query(
    "dat03_month_timeline",
    """select m.time, coalesce(sum(f.cnt), 0)::bigint as cnt
       from (select strftime(g, '%Y%m') as time from range(date '1995-11-01', date '1996-04-01', interval 1 month) r(g)) m
       left join month_flow f using (time) group by m.time""",
)
def _(t):
    months = periods.month_timeline(t.spark, (1995, 11), (1996, 3))
    flow = t.flow("month").groupBy("time").agg(F.sum("cnt").alias("cnt"))
    return months.join(flow, "time", "left").na.fill(0)
