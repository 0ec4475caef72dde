"""What the optimizer makes of the catalogue: pushdown, pruning, kinds of joins, limits by group, shuffles saved."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.plans import catalogue
from tessera.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def whole_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(catalogue.QUERIES["project_filter"](spark, FOLDER))
    assert "GreaterThan(l_quantity,45.0)" in plan and "GreaterThanOrEqual(l_discount,0.02)" in plan
    assert "l_shipdate" not in plan.split("ReadSchema")[1]


def test_partitions_are_pruned(spark):
    plan = plan_of(catalogue.QUERIES["partition_pruning"](spark, FOLDER))
    assert "o_orderstatus" in plan.split("PartitionFilters: [")[1].split("]")[0] and "Exchange" not in plan


@pytest.mark.parametrize(("name", "node"), [("shuffle_hash_join", "ShuffledHashJoin"), ("region_revenue_six_way", "BroadcastHashJoin"), ("topk_per_group", "WindowGroupLimit"), ("sort_limit_offset", "TakeOrderedAndProject"), ("window_ranks", "Window"), ("theta_join", "BroadcastNestedLoopJoin")])
def test_nodes(spark, name, node):
    assert node in plan_of(catalogue.QUERIES[name](spark, FOLDER))


def test_buckets_join_without_a_shuffle(spark):
    plan = plan_of(catalogue.QUERIES["bucketed_join"](spark, FOLDER))
    assert "SortMergeJoin" in plan and "hashpartitioning(k" not in plan


def test_aggregates_combine_before_they_shuffle(spark):
    plan = plan_of(catalogue.QUERIES["pricing_summary"](spark, FOLDER))
    assert plan.count("HashAggregate") == 2 and "partial_" in plan.split("Exchange")[1]


def test_no_query_makes_all_pairs_of_large_tables(spark):
    for name in ("asof_purchase_view", "range_join_events", "correlated_latest", "exists_non_equi", "self_join_pairs"):
        assert "CartesianProduct" not in plan_of(catalogue.QUERIES[name](spark, FOLDER)), name


@pytest.mark.parametrize(("name", "by"), [("correlated_latest", "o_orderdate"), ("lateral_top2", "o_totalprice")])
def test_limits_of_correlated_subqueries_number_rows_by_their_order(spark, name, by):
    """A number without an order follows the arrival of shuffled rows, which several executors change."""
    plan = plan_of(catalogue.QUERIES[name](spark, FOLDER))
    assert re.search(rf"row_number\(\) windowspecdefinition\(o_custkey#\d+L?, {by}#\d+ DESC NULLS LAST, o_orderkey#\d+L? ASC", plan)


def test_late_rows_are_dropped(spark):
    """The stream of three batches counts no day before the eleventh, though the table has such days."""
    late = table(spark, FOLDER, "events").filter("ts < '2024-01-11'").count()
    found = catalogue.QUERIES["stream_late_rows"](spark, FOLDER)
    assert late > 0 and found.filter(F.col("start") < "2024-01-11").count() == 0
