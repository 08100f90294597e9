"""The test tables as the inputs the operators expect (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflux.catalog.views import SCORE_ROUNDS
from odflux.functions import periods
from odflux.graph.degree import build_graph, degrees, gross_flow, net_inflow_per_mille
from odflux.graph.rank import hits
from odflux.operators.aggregates import user_day_od_count
from odflux.operators.filters import drop_self_edges
from odflux.operators.text import place_texts, text_parts
from odflux.session import materialize, scratch_path


def rounded(df: DataFrame, digits: int, *columns) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def cents(column: str):
    """Whole cents, so that sums are exact in every order."""
    return F.round(F.col(column) * 100).cast("bigint")


_SCHEMAS: dict = {}


class Tables:
    """Lazy views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._text_parts = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def path(self, name: str) -> str:
        """A fresh folder below the shared one, for data written and read back."""
        return scratch_path(self.spark, name)

    # ---- dimensions --------------------------------------------------------

    def place(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_name").alias("name"), key.alias("place_key"), F.col("r_name").alias("province"),
            (key % 6).alias("tier"), (key * 37 % 100).cast("double").alias("mc_x"),
            (key * 53 % 100).cast("double").alias("mc_y"),
        )

    def tiers(self) -> DataFrame:
        return self.place().where("place_key < 23").select("name", "tier")

    def location(self) -> DataFrame:
        return self.place().where("place_key < 24").select(
            "name", "mc_x", "mc_y", (F.col("mc_x") / 10).alias("ll_x"), (-F.col("mc_y") / 10).alias("ll_y")
        )

    def region_city(self) -> DataFrame:
        key = F.col("place_key")
        region = F.when(key < 5, "R1").when(key < 12, "R2").otherwise("R3")
        return self.place().where(key < 18).select(region.alias("region"), "name")

    def translation(self) -> DataFrame:
        return self.place().select("name", F.concat(F.lit("Place "), F.col("place_key").cast("string")).alias("en_name"))

    def aliases(self) -> DataFrame:
        return self.place().where("place_key % 9 = 4").select("name", F.concat("name", F.lit("_OLD")).alias("alias"))

    # ---- trips and flows -----------------------------------------------------
    # Flows are counted by place keys; names are joined to the counts, not to the trips.

    def _keyed_trip(self, typed: bool = False) -> DataFrame:
        """A trip per line item: user, day, and the keys of both places."""
        buyers = self.customer.select("c_custkey", F.col("c_nationkey").alias("from_key"))
        sellers = self.supplier.select("s_suppkey", F.col("s_nationkey").alias("to_key"))
        users = self.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
            "o_orderkey", F.col("o_custkey").alias("userid"), F.to_date("o_orderdate").alias("event_date"), "from_key"
        )
        lines = self.lineitem
        columns = ["userid", "event_date", "from_key", "to_key"]
        if typed:
            kinds = self.part.select("p_partkey", F.col("p_type").alias("value"))
            lines = lines.join(kinds, F.col("l_partkey") == F.col("p_partkey"))
            columns.append("value")
        lines = lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        return lines.join(users, F.col("l_orderkey") == F.col("o_orderkey")).select(*columns)

    def _named(self, df: DataFrame, source: str, target: str, province: bool = False) -> DataFrame:
        """Replace place keys by names, and provinces where asked."""
        place = self.place() if province else self.nation.select(
            F.col("n_name").alias("name"), F.col("n_nationkey").alias("place_key")
        )
        for key, name, wide in (("from_key", source, "province_from"), ("to_key", target, "province_to")):
            columns = [F.col("place_key").alias(key), F.col("name").alias(name)]
            if province:
                columns.append(F.col("province").alias(wide))
            df = df.join(place.select(*columns), key).drop(key)
        return df

    def trip(self, typed: bool = False) -> DataFrame:
        return self._named(self._keyed_trip(typed), "city_from", "city_to", province=True)

    def _keyed_daily(self, *extra) -> DataFrame:
        return user_day_od_count(self._keyed_trip(bool(extra)), ["event_date", "from_key", "to_key", *extra])

    def daily_flow(self) -> DataFrame:
        daily = self._named(self._keyed_daily(), "city_from", "city_to", province=True)
        return daily.select("event_date", "province_from", "city_from", "province_to", "city_to", "cnt")

    def flow(self, grain: str = "season") -> DataFrame:
        """City edges of a time grain, self edges included."""
        sums = self._keyed_daily().groupBy(
            periods.period_label("event_date", grain).alias("time"), "from_key", "to_key"
        ).agg(F.sum("cnt").alias("cnt"))
        return self._named(sums, "src", "dst").select("time", "src", "dst", "cnt")

    def edges(self) -> DataFrame:
        return drop_self_edges(self.flow())

    def typed_flow(self) -> DataFrame:
        sums = self._keyed_daily("value").groupBy(
            periods.season_str("event_date").alias("time"), "value", "from_key", "to_key"
        ).agg(F.sum("cnt").alias("cnt"))
        return self._named(sums, "src", "dst").select("time", "value", "src", "dst", "cnt")

    # ---- demand, wages, output -------------------------------------------------

    def wage(self) -> DataFrame:
        buyers = self.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("key"))
        sums = (
            self.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.year("o_orderdate").alias("year"), "key")
            .agg((F.sum(cents("c_acctbal")) / F.count("*")).alias("wage"))
        )
        return self._with_name(sums).select("year", "name", "wage")

    def gdp(self) -> DataFrame:
        buyers = self.customer.select("c_custkey", F.col("c_nationkey").alias("key"))
        sums = (
            self.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("key").agg((F.sum(cents("o_totalprice")) / 100000000).alias("gdp"))
        )
        return self._with_name(sums).select("name", "gdp")

    def demand(self) -> DataFrame:
        kinds = self.part.select("p_partkey", F.col("p_type").alias("type"))
        sellers = self.supplier.select("s_suppkey", F.col("s_nationkey").alias("key"))
        sums = (
            self.lineitem.join(kinds, F.col("l_partkey") == F.col("p_partkey"))
            .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(periods.season_str("l_shipdate").alias("time"), "key", "type").agg(F.count("*").alias("cnt"))
        )
        return self._with_name(sums).select("time", "name", "type", "cnt")

    def _with_name(self, df: DataFrame) -> DataFrame:
        names = self.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
        return df.join(names, "key").drop("key")

    def topic_count(self) -> DataFrame:
        buyers = self.customer.select("c_custkey", F.col("c_nationkey").alias("key"))
        users = self.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
            "o_orderkey", periods.season_str("o_orderdate").alias("time"), "key"
        )
        sums = (
            self.lineitem.join(users, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("time", "key", (F.col("l_partkey") % 30).cast("int").alias("topic"))
            .agg(F.count("*").alias("cnt"))
        )
        return self._with_name(sums).select("time", "name", "topic", "cnt")

    # ---- texts and logs --------------------------------------------------------

    def post(self) -> DataFrame:
        day = F.date_add(F.lit("2019-08-01").cast("date"), (F.col("doc_id") % 1000).cast("int"))
        if self._text_parts is None:
            self._text_parts = text_parts(self.documents, "text")
        placed = place_texts(self.documents, "doc_id", "text", self._text_parts)
        return placed.join(self.nation, F.col("doc_id") % 25 == F.col("n_nationkey")).select(
            "doc_id", F.col("n_name").alias("city"), F.date_format(day, "yyyy-MM-dd").alias("startdate"),
            F.col("text").alias("title"),
        )

    def annotation(self) -> DataFrame:
        return self.labels.join(self.documents.select("doc_id", "lang"), "doc_id").select(
            "doc_id", F.col("lang").alias("name"), F.col("quality").alias("label"), F.col("toxic").alias("label2")
        )

    def log_event(self) -> DataFrame:
        return self.events.select(
            "event_id", F.col("user_id").cast("string").alias("userid"), F.col("ts").alias("event_time"),
            F.col("event_type").alias("query"), F.col("props").alias("title"),
            (F.col("user_id") % 100 * 40.0).alias("x"), (F.col("value") * 10).alias("y"),
        )

    def grid(self) -> DataFrame:
        """Grid cells of the log points; some cells belong to no place."""
        cell = lambda c: F.floor(F.col(c).cast("bigint") / 500.0)
        cells = self.log_event().select(cell("x").alias("gx"), cell("y").alias("gy")).distinct()
        cells = cells.where((F.col("gx") + F.col("gy")) % 5 != 4)
        place = self.place().select("place_key", "province", F.col("name").alias("city"))
        return cells.join(place, (F.col("gx") * 7 + F.col("gy") * 3) % 25 == F.col("place_key")).select(
            (F.col("gx") * 100000 + F.col("gy")).alias("grid_id"), "province", "city"
        )

    def area(self) -> DataFrame:
        """Dictionary of the words in part names at three place levels."""
        place = self.place()
        names = self.part.select("p_name", "p_size")
        word = lambda i: F.split("p_name", " ")[i].alias("word")
        none = F.lit(None).cast("string")
        first = names.select(word(0)).distinct()
        second = names.select(word(1)).distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        full = names.select(F.col("p_name").alias("word")).distinct()
        wide = first.join(
            place.where("place_key < 5").select("place_key", "province"), F.length("word") % 5 == F.col("place_key")
        ).select(
            "word", "province", none.alias("city"), none.alias("region"), F.lit(0).alias("level"),
            F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("original_level"),
        )
        middle = second.join(place, (F.length("word") * 3 + F.col("k") * 7) % 25 == F.col("place_key")).select(
            "word", "province", F.col("name").alias("city"), none.alias("region"), F.lit(1).alias("level"),
            F.col("mc_x").alias("x"), F.col("mc_y").alias("y"), (F.col("k") + 1).alias("original_level"),
        )
        narrow = full.join(place, F.length("word") % 25 == F.col("place_key")).select(
            "word", "province", F.col("name").alias("city"), F.col("word").alias("region"), F.lit(2).alias("level"),
            F.col("mc_x").alias("x"), F.col("mc_y").alias("y"), F.lit(2).alias("original_level"),
        )
        return wide.unionByName(middle).unionByName(narrow)

    def search(self) -> DataFrame:
        """A search per line item: two part names, with the place of its customer."""
        place = self.place()
        who = self.customer.join(place, F.col("c_nationkey") == F.col("place_key")).select(
            "c_custkey", F.col("mc_x").alias("x"), F.col("mc_y").alias("y"), "province", F.col("name").alias("city")
        )
        asked = self.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("query"))
        seen = self.part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("title"))
        return (
            self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
            .join(asked, "l_partkey").join(seen, "l_suppkey")
            .join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(who, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_custkey").alias("userid"), F.col("o_orderdate").alias("event_time"), "query", "title",
                F.concat("query", F.lit(";;"), "title").alias("text"), "x", "y", "province", "city",
            )
        )

    # ---- derived tables --------------------------------------------------------

    def season_label(self) -> DataFrame:
        """A label per quarter and place: that of the strongest destination."""
        key = self.place().select(F.col("name").alias("dst"), (F.col("place_key") % 5).alias("label"))
        order = F.struct((-F.col("cnt")).alias("c"), F.col("dst").alias("d"), F.col("label").alias("label"))
        return (
            self.edges().join(key, "dst").groupBy("time", F.col("src").alias("name"))
            .agg(F.min(order).alias("m")).select("time", "name", F.col("m.label").alias("label"))
        )

    def score(self) -> DataFrame:
        """Degrees, hubs, authorities, gross flow and net inflow per quarter and place."""
        flow = materialize(self.flow(), "season")
        graph = materialize(build_graph(drop_self_edges(flow), self.location()), "located")
        flows = gross_flow(flow).join(net_inflow_per_mille(flow), ["time", "name"])
        table = degrees(graph).join(hits(graph, rounds=SCORE_ROUNDS), ["time", "name"], "full_outer")
        table = table.join(flows, ["time", "name"], "full_outer").na.fill(0)
        return materialize(
            table.select(
                "time", "name", "flow_in", "flow_out", "flow_in_net", "hub", "authority",
                "gross_flow", "flow_in_net_country_norm",
            ),
            "score",
        )
