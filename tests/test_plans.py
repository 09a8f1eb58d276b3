"""What reaches the Parquet scan."""

import pytest

from docquarry.operators import entries
from docquarry.plans.catalog import QUERIES


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        ("match_attr", ["EqualTo(lang,en)"]),
        ("prefix_attr", ["StringStartsWith(p_name,red)"]),
        ("range_numeric", ["GreaterThanOrEqual(o_totalprice,1000.0)", "LessThan(o_totalprice,5000.0)"]),
        ("range_open_end", ["GreaterThanOrEqual(o_totalprice,400000.0)"]),
        ("match_whole_row", ["EqualTo(o_orderpriority,1-URGENT)", "EqualTo(o_orderstatus,F)"]),
        ("bool_and", ["EqualTo(lang,en)"]),
        ("ts_select", ["EqualTo(s_nationkey,3)", "GreaterThanOrEqual(s_acctbal,0.0)"]),
        ("page_next", ["GreaterThan(doc_id,59)"]),
        ("index_word_search", ["StringStartsWith(word,ther)", "StringStartsWith(word,and)"]),
    ],
)
def test_filters_reach_the_scan(spark, tiny, name, wanted):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    shown = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for test in wanted:
        assert test in shown, shown


def test_describing_shuffles_once(spark, tiny):
    parts = spark.read.parquet(f"{tiny}/part.parquet")
    shown = entries.describe(entries.to_entries(parts, "p_partkey", ["p_name", "p_size"]))._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange ") == 1
