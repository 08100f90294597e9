"""Registered queries against their SQL on small tables.

A few of each family run by default; ODFLUX_ALL_QUERIES=1 runs all of them.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.01"
SAMPLE = [
    "src01_scan_event_log", "src03_scan_transitions", "fil02_safe_parse", "fil13_sample_n", "joi05_full_outer_fill",
    "joi11_drop_covering_areas", "agg08_category_sum", "agg13_p_values", "agg19_array_sum_by", "agg12_five_number_summary", "agg22_multi_grain_rollup",
    "win01_average_rank_desc", "geo02_query_process", "txt04_tf_vector", "grf05_pagerank_dangling", "grf06_hits",
    "grf10_typed_centrality_table", "ana05_tier_flow_change", "ana08_salary_difference", "ana20_choropleth",
]
NAMES = sorted(oracle_sql()) if os.environ.get("ODFLUX_ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    assert len(got)
    assert difference(got, duck.execute(oracle_sql()[name]).df()) is None


def test_entry_has_rows(spark):
    assert not entry(spark).isEmpty()


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
