"""The physical plans that operators lead to: what reaches the scan, and how often rows are shuffled."""

import re

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def table(session, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('t')}/rows"
    session.spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit("x").alias("w")).write.parquet(at)
    return lambda: session.table(at)


def plan(dataset):
    return dataset.df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return len(re.findall(r"Exchange (?!Single)\w*partitioning|Exchange RoundRobin", text))


def test_filters_and_columns_reach_the_scan(table):
    p = plan(table().filter(F.col("v") < 3).map("k", twice=F.col("k") * 2))
    assert "PushedFilters: [IsNotNull(v), LessThan(v,3)]" in p and re.search(r"ReadSchema: struct<k:bigint,v:bigint>", p)
    assert shuffles(p) == 0


def test_native_operators_stay_out_of_python(table):
    d = table()
    for x in (d.map("k"), d.flat_map(F.array("k", "v")), d.map("v", "k").reduce_by_key(), d.map("k", "v").join(d.map("k", "w")), d.sort_by("k")):
        assert not re.search("Python|Arrow|Pandas", plan(x))


def test_keyed_aggregation_combines_before_its_one_shuffle(table):
    p = plan(table().map("v", "k").reduce_by_key("sum"))
    assert shuffles(p) == 1 and "partial_sum" in p and "w" not in re.search(r"ReadSchema: (\S+)", p)[1].replace("struct", "")


def test_opaque_combiners_shuffle_once(table):
    p = plan(table().map("v", "k").reduce_by_key_with(max))
    assert shuffles(p) == 1 and p.count("MapInArrow") == 2


def test_cogroup_shuffles_all_sides_once(table):
    d = table().map("k", "v")
    assert shuffles(plan(d.group_with(d, d))) == 1


def test_take_of_sorted_is_fused(session, table):
    d = table().map("k", "v").sort_by("v", ascending=False)
    from brindle.functions.order import columns_of

    text = d._df.orderBy(*columns_of(d.order)).limit(5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and shuffles(text) == 0


def test_narrow_operators_do_not_shuffle(session):
    d = session.range(100).filter("id > 3").map(x=F.col("id") + 1).map_with(lambda r: r["x"], "x long").glom()
    assert shuffles(plan(d)) == 0
    assert shuffles(plan(session.range(10).union(session.range(5)))) == 0


def test_small_sides_are_broadcast_and_large_ones_merged(spark, table):
    d = table().map("k", "v")
    assert "BroadcastHashJoin" in plan(d.join(table().map("k", "w")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(d.join(table().map("k", "w")))
        assert "SortMergeJoin" in p and "CartesianProduct" not in p and "BroadcastNestedLoop" not in p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
