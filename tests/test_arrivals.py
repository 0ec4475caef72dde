"""State over several runs of a stream: sums go on across them, what has expired is gone from the store."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.streaming import arrivals, events

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def weeks(spark):
    events.rocksdb(spark)
    return arrivals.run_in_parts(arrivals.in_parts(spark, FOLDER), arrivals.weekly)


def test_sums_cross_the_arrivals_and_expired_keys_go(spark, weeks):
    told, place = weeks
    parts = arrivals.in_parts(spark, FOLDER)
    week = F.date_trunc("week", "ts").cast("date").alias("week")
    shared = parts[0].select("user_id", week, "event_type").join(parts[1].select("user_id", week, "event_type"), ["user_id", "week", "event_type"], "left_semi").distinct()
    assert shared.count() > 10 and told.join(shared, ["user_id", "week", "event_type"]).count() > 10
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("user_id", week, "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    assert told.exceptAll(every).count() == 0 and told.count() == told.select("user_id", "week", "event_type").distinct().count()
    # what is left in the store are the users of the week that is still open
    left = spark.read.format("statestore").option("stateVarName", "kinds").load(place).select("key.user_id", "key.week").distinct()
    open_weeks = every.filter(F.col("week") > told.agg(F.max("week")).first()[0]).select("user_id", "week").distinct()
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, open_weeks.collect())) and left.count() > 0


def test_late_events_dont_count(spark):
    events.rocksdb(spark)
    at = lambda day, kind="click": (1, 7, kind, 1.0, datetime.datetime(2024, 1, day, 12))
    part = lambda *rows: spark.createDataFrame(list(rows), "event_id long, user_id long, event_type string, value double, ts timestamp")
    told, _ = arrivals.run_in_parts([part(at(2), at(3)), part(at(20)), part(at(4), at(20, "view")), part(at(30))], arrivals.weekly)
    assert sorted(map(tuple, told.collect())) == [(7, datetime.date(2024, 1, 1), "click", 2, 1.0), (7, datetime.date(2024, 1, 15), "click", 1, 1.0), (7, datetime.date(2024, 1, 15), "view", 1, 1.0)]
