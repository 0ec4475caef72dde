"""The format of our own: filters reach the reader and its row groups, commits count whole, aborted writes leave no rows."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

from tessera.plans import catalogue
from tessera.sources.parts import MANIFEST, Parts, PartsReader

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def place(spark, tmp_path):
    spark.dataSource.register(Parts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return f"file://{tmp_path}/table"


def saved(df, place, mode="append", **options):
    df.write.format("tessera_parts").mode(mode).option("path", place).options(**options).save()


def read(spark, place):
    return spark.read.format("tessera_parts").option("path", place).load()


def test_rows_return_and_appends_add(spark, place):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    saved(rows.repartition(3), place)
    assert sorted(map(tuple, read(spark, place).collect())) == sorted(map(tuple, rows.collect()))
    saved(rows, place)
    assert read(spark, place).count() == 2000
    saved(rows.limit(7), place, "overwrite")
    assert read(spark, place).count() == 7
    assert read(spark, place).filter("s IS NULL").count() == rows.limit(7).filter("s IS NULL").count() > 0


def test_filters_are_pushed_and_prune_row_groups(spark, place):
    saved(spark.range(10_000).coalesce(1), place, group_rows=500)
    few = read(spark, place).filter("id > 9700 AND id IN (1, 9800, 9999)")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    assert [r.id for r in few.orderBy("id").collect()] == [9800, 9999] and few.rdd.getNumPartitions() == 1
    reader = PartsReader(place)
    assert list(reader.pushFilters([GreaterThan(("id",), 9700), StringContains(("id",), "x"), In(("id",), (3, 9800)), EqualTo(("a", "b"), 1)])) == [StringContains(("id",), "x"), EqualTo(("a", "b"), 1)]
    assert len(reader.partitions()) == 1 and sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 1
    nothing = PartsReader(place)
    assert list(nothing.pushFilters([GreaterThan(("id",), 10_000)])) == [] and list(nothing.read(nothing.partitions()[0])) == []


def test_an_aborted_write_leaves_no_rows(spark, place, tmp_path):
    saved(spark.range(10), place)
    before = sorted(os.listdir(tmp_path / "table"))
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.raise_error(F.lit("broken row")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="broken row"):
        saved(bad, place)
    assert read(spark, place).count() == 10 and MANIFEST in before
    assert isinstance(pa.schema([]), pa.Schema)


def test_reading_nothing_is_an_error(spark, place):
    with pytest.raises(Exception, match="no table was committed"):
        read(spark, place)


def test_query_pushes(spark):
    df = catalogue.QUERIES["python_source"](spark, FOLDER)
    assert df.count() > 0
