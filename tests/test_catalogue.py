"""Every catalogued query against an independent engine on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tessera.plans import catalogue
from tessera.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    engine = duckdb.connect()
    for name in TABLES:
        engine.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return engine


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_the_other_engine(spark, other, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    want = other.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLES.keys()))
def test_queries_without_sql_run(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).columns
