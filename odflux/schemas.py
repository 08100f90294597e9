"""Declared schemas; no source infers its types."""

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

# Tab-separated search log. Only the five named positions are used.
EVENT_LOG = T.StructType(
    [
        T.StructField(name, S, True)
        for name in (
            "query c1 location c3 title userid c6 c7 c8 c9 c10 c11 c12 stamp c14".split()
        )
    ]
)

TRIPS = _struct(
    userid=S, year=I, month=I, day=I, hour=I,
    province_from=S, city_from=S, province_to=S, city_to=S, query=S,
)
DAILY_FLOW = _struct(
    time=S, province_from=S, city_from=S, province_to=S, city_to=S, count=L,
)
TRANSITIONS = T.StructType(
    [
        T.StructField("event_date", T.DateType()),
        *[T.StructField(c, S) for c in ("province_from", "city_from", "province_to", "city_to")],
        T.StructField("cnt", L),
        T.StructField("month", S),
    ]
)
FLOW_GRAPH = T.StructType(
    [T.StructField("time", S), T.StructField("from", S), T.StructField("to", S), T.StructField("count", L)]
)
TYPED_TRANSITIONS = _struct(
    time=S, province_from=S, city_from=S, province_to=S, city_to=S, value=S, count=L,
)
TYPED_DEMAND = _struct(time=S, city=S, type=S, count=L)
POSTS = _struct(city=S, startdate=S, title=S, description=S)
TOPIC_COUNTS = _struct(city=S, time=I, topic=I, count=L)
CITY_TIER = _struct(city=S, level=I)
TRANSLATION = _struct(name=S, en_name=S)
LOCATION_LL = _struct(name=S, ll_x=D, ll_y=D)
LOCATION_MC = _struct(name=S, mc_x=D, mc_y=D)
AREAS = _struct(city=S, province=S)
GDP = _struct(name=S, gdp=D)
CITY_STATISTICS = _struct(year=I, name=S, wage=D)
AREA_DICTIONARY = _struct(
    word=S, province=S, city=S, region=S, level=I, x=D, y=D, original_level=I,
)
GRID_DICTIONARY = _struct(grid_id=L, province=S, city=S)
GEOJSON = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "properties",
                            T.StructType(
                                [
                                    T.StructField("name", S),
                                    T.StructField("center", T.ArrayType(D)),
                                ]
                            ),
                        )
                    ]
                )
            ),
        )
    ]
)
