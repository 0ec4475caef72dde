"""Queries on tables of a shape that larger ones have: large keys, repeated rows, many groups, other partitions. Held against the other engine."""

import datetime
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import user
from tessera.operators import vectors
from tessera.plans import catalogue
from tessera.streaming import arrivals, events
from test_catalogue import rows

FOLDER = "/root/testdata/sf0.001"


def agrees(spark, folder, name, *tables):
    engine = duckdb.connect()
    for t in tables:
        engine.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(folder)), engine.sql(catalogue.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_years_of_five_and_six_digits(spark, tmp_path):
    """Days after 1970 past the year 9999, and past the last timestamp."""
    keys = [0, 1, 4, 2_932_896, 2_932_897, 9_000_001, 106_751_991, 106_751_992, 500_000_003]
    at = datetime.datetime(1999, 5, 6)
    spark.createDataFrame([(k, at) for k in keys], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    agrees(spark, tmp_path, "timestamps_parsed", "orders")


def copied(spark, folder, times):
    """The events again and again over the same days, with ids and users of their own."""
    many = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).selectExpr("event_id + k * 1000 AS event_id", "ts", "user_id + k * 15 AS user_id", "event_type", "value", "props")
    many.write.parquet(f"{folder}/events.parquet")


def test_arrivals_go_by_time_whatever_the_ids(spark, tmp_path):
    """Ids that don't rise with time make no event late."""
    copied(spark, tmp_path, 3)
    agrees(spark, tmp_path, "stream_weeks_by_user", "events")
    agrees(spark, tmp_path, "stream_hours_across_parts", "events")


def test_weeks_of_missing_values(spark):
    """A missing value counts as an event but isn't the largest, in one arrival and over two."""
    events.rocksdb(spark)
    at = lambda day, value: (1, 7, "click", value, datetime.datetime(2024, 1, day, 12))
    part = lambda *of: spark.createDataFrame(list(of), "event_id long, user_id long, event_type string, value double, ts timestamp")
    told, _ = arrivals.run_in_parts([part(at(2, None), at(3, 1.5)), part(at(4, None), at(9, None)), part(at(30, 1.0))], arrivals.weekly)
    assert sorted(map(tuple, told.collect())) == [(7, datetime.date(2024, 1, 1), "click", 3, 1.5), (7, datetime.date(2024, 1, 8), "click", 1, None)]


@pytest.mark.parametrize("name", ["approx_distinct_bound", "sketch_bounds"])
def test_no_sketch_for_each_distinct_value(spark, name):
    """No step of the plan keeps sketches by status and order key."""
    plan = catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    by_value = [line for line in plan.splitlines() if re.search(r"Aggregate \[l_linestatus#\d+, l_orderkey#\d+L?\]", line)]
    assert by_value and not any(re.search("sketch|approx|median|percentile", line) for line in by_value)


def test_cogrouped_customers_share_calls(spark, tmp_path, monkeypatch):
    """Repeated customers, missing keys, orders of nobody, a customer with most orders; a call for each group of many customers, not for each customer."""
    customers = [(1, 5.0), (1, 5.0), (1, 7.0), (2, None), (None, 1.0), (2**53 + 1, 4.0), *((k, 1.0) for k in range(10, 400))]
    orders = [(k, 1) for k in range(500)] + [(500, 2), (None, 2), (501, None), (502, 999), (503, 2**53 + 1)]
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    agrees(spark, tmp_path, "udf_cogrouped_map", "customer", "orders")
    plan = catalogue.QUERIES["udf_cogrouped_map"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan
    monkeypatch.setattr(user, "BUCKET", 100)
    agrees(spark, tmp_path, "udf_cogrouped_map", "customer", "orders")


@pytest.mark.parametrize(("block", "strip"), [(vectors.BLOCK, vectors.STRIP), (70, 3)])
def test_nearest_of_all_in_blocks(spark, tmp_path, monkeypatch, block, strip):
    """Copies in different blocks, nearly equal vectors and zeros give the rows of the SQL, and no pair is a row of the plan."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "STRIP", strip)
    at = np.random.default_rng(4)
    x = at.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:200] = x[np.arange(100) % 7]
    x[200:230] = x[3] * (1 + 1e-7 * np.arange(30))[:, None]
    x[280:] = 0
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    agrees(spark, tmp_path, "vector_top1", "embeddings")
    assert "Join" not in catalogue.QUERIES["vector_top1"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
