"""As-of joins in slices and overlaps of spans against plain loops; what tasks hold; plans."""

import datetime
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
BEGIN = datetime.datetime(2024, 1, 1)


def at(s):
    return None if s is None else BEGIN + datetime.timedelta(seconds=s)


def latest(left, right):
    """By comparing all pairs."""
    out = []
    for n, (k, t) in enumerate(left):
        seen = [(u, v) for j, u, v in right if k is not None and j == k and t is not None and u is not None and u <= t and v is not None]
        out.append((n, max(seen)[1] if seen else None))
    return sorted(out)


rows = st.tuples(st.sampled_from([None, 1, 2]), st.one_of(st.none(), st.integers(-50, 300)))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(left=st.lists(rows, max_size=12), right=st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.one_of(st.none(), st.integers(-50, 300)), st.one_of(st.none(), st.integers(0, 9))), max_size=14), seconds=st.sampled_from([7, 60, 1000]))
def test_slices_find_the_latest(spark, left, right, seconds):
    a = spark.createDataFrame([(n, k, at(t)) for n, (k, t) in enumerate(left)], "n long, k long, ts timestamp_ntz")
    b = spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k long, ts timestamp_ntz, v long")
    got = sorted((r.n, r.v_asof) for r in joins.asof_in_slices(a, b, ["k"], "ts", "v", seconds).collect())
    assert got == latest(left, right)


def test_no_task_holds_a_hot_key(spark):
    """One user has all rows: they are spread over the slices' tasks, and what is carried on has a row for each slice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        views = spark.range(40_000).select(F.lit(1).alias("k"), (F.timestamp_seconds(F.col("id") * 60)).cast("timestamp_ntz").alias("ts"), F.col("id").alias("v"))
        asks = views.select("k", (F.col("ts") + F.expr("INTERVAL 5 SECONDS")).alias("ts"), F.col("v").alias("want"))
        found = joins.asof_in_slices(asks, views, ["k"], "ts", "v", 3600)
        assert found.filter("v_asof <> want OR v_asof IS NULL").count() == 0
        sizes = [r.n for r in found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("v_asof").alias("n")).collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 8_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize(("seed", "width"), [(1, 1.0), (2, 0.3), (3, 50.0)])
def test_spans_of_all_lengths(spark, seed, width):
    draw = random.Random(seed)

    def made(n):
        out = [(k, float(a := draw.randrange(-100, 400)), float(a + draw.choice([0, 0, 1, 3, 10, 90, 1000, -1]))) for k in range(n)]
        return [*out, (n, None, 3.0), (n + 1, 3.0, None), out[0]]

    left, right = made(60), made(50)
    a, b = spark.createDataFrame(left, "i long, s double, e double"), spark.createDataFrame(right, "j long, t double, f double")
    got = joins.overlapping(a, b, ("s", "e"), ("t", "f"), width)
    want = [(i, j) for i, s, e in left for j, t, f in right if None not in (s, e, t, f) and s <= e and t <= f and s <= f and t <= e]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want) and len(want) > 50
    assert joins.overlapping(a.limit(0), b, ("s", "e"), ("t", "f"), width).count() == 0


@pytest.mark.parametrize("name", ["overlap_sessions_errors", "overlap_own_orders", "vector_index_top1", "asof_purchase_view"])
def test_no_nested_loops(spark, name):
    plan = catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
