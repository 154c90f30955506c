"""What the physical plans must look like."""

import re

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
QUERIES = entry.queries()
# Queries that write files, run streams or iterate while they are built.
BUILDS = ("src0", "src1", "st0", "rg11", "rg12", "op", "pipeline")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(BUILDS)))
def test_no_products(spark, name):
    text = plan(QUERIES[name](spark, ROOT))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_range_join_keeps_equi_keys(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["j06_window_join"](spark, ROOT))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = re.search(r"SortMergeJoin \[(.*?)\], \[(.*?)\]", text)
    assert join and len(join.group(1).split(",")) == 3


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["prj02_get_case"](spark, ROOT))
    assert "EqualTo(o_orderkey,77)" in text
    assert "o_orderdate" not in text.split("ReadSchema")[1]


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(QUERIES["tk03_top_k_per_query"](spark, ROOT))
    assert text.count("WindowGroupLimit") == 2


def test_tag_stats_combine_before_the_shuffle(spark):
    text = plan(QUERIES["agg02_stats_by_tag"](spark, ROOT))
    assert "partial_count" in text


def test_large_top_k_sorts_no_whole_group(spark):
    from pyspark.sql import functions as F

    from scorelake.operators.ranking import top_k
    rows = spark.range(9000).select((F.col("id") % 3).alias("g"), "id")
    got = top_k(rows, ["g"], [F.desc("id")], 2000)
    assert plan(got).count("Window") >= 2 and got.count() == 6000 and got.agg(F.min("id")).first()[0] == 3000
