"""Samples, frames with exclusions and stored sketches on made rows: nulls, ties, hot groups."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import excluded, samples, sketches


def made(seed, n=160):
    at = random.Random(seed)
    return [(k, at.choice(["a", "b", None]), at.choice([None, 1, 1, 2, 3, 5]), at.choice([None, 1.0, 2.0, 2.0, 7.0, -3.0])) for k in range(n)]


def frame_of(rows, row, exclude, frame):
    """By definition: the frame's rows less the excluded ones; null keys are equal, and first in the order."""
    k, g, o, _ = row
    rank = lambda x: (x is not None, x or 0)
    inside = [r for r in rows if r[1] == g and (frame == "all" or (rank(r[2]) <= rank(o) if frame == "so_far" else rank(r[2]) >= rank(o)))]
    if exclude == "CURRENT ROW":
        inside = [r for r in inside if r[0] != k]
    elif exclude == "GROUP":
        inside = [r for r in inside if r[2] != o]
    else:
        inside = [r for r in inside if r[2] != o or r[0] == k]
    values = [r[3] for r in inside if r[3] is not None]
    return (max(values), min(values)) if values else (None, None)


@pytest.mark.parametrize("exclude", ["CURRENT ROW", "GROUP", "TIES"])
@pytest.mark.parametrize("frame", ["all", "so_far", "from_here"])
def test_extremes_by_definition(spark, exclude, frame):
    for seed, n in ((1, 160), (2, 5)):
        rows = made(seed, n)
        df = spark.createDataFrame(rows, "k long, g string, o int, v double")
        got = {r.k: (r.x_max, r.x_min) for r in excluded.extremes(df, ["g"], "o", "v", exclude, frame).collect()}
        assert got == {r[0]: frame_of(rows, r, exclude, frame) for r in rows}
    assert excluded.extremes(df.limit(0), ["g"], "o", "v", exclude, frame).count() == 0
    with pytest.raises(ValueError):
        excluded.extremes(df, ["g"], "o", "v", "NOTHING")


def test_sizes_are_exact_and_runs_agree(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id < 4000 THEN 'hot' WHEN id < 4990 THEN 'some' WHEN id < 4995 THEN 'few' END AS s")
    first = samples.stratified(df, ["s"], ["id"], 20, seed=5)
    digest = lambda k: hashlib.md5(f"5|{k}".encode()).hexdigest()
    want = {s: sorted(ids, key=digest)[:20] for s, ids in {"hot": range(4000), "some": range(4000, 4990), "few": range(4990, 4995), None: range(4995, 5000)}.items()}
    for found in (first, samples.stratified(df.repartition(7), ["s"], ["id"], 20, seed=5)):
        got = {}
        for r in found.collect():
            got.setdefault(r.s, set()).add(r.id)
        assert got == {s: set(v) for s, v in want.items()}
    assert {(r.s, r["count"]) for r in samples.stratified(df, ["s"], ["id"], {"hot": 3, None: 2}).groupBy("s").count().collect()} == {("hot", 3), (None, 2)}
    assert {r.s: r["count"] for r in samples.shares(df, ["s"], ["id"], 0.1, seed=5).groupBy("s").count().collect()} == {"hot": 400, "some": 99, "few": 1, None: 1}
    tenth = {r.id for r in samples.shares(df, ["s"], ["id"], 0.1, seed=5).collect() if r.s == "some"}
    assert tenth == set(sorted(range(4000, 4990), key=digest)[:99])
    with pytest.raises(ValueError):
        samples.stratified(df, ["s", "id"], ["id"], {"hot": 3})


def test_copies_count_as_rows_of_a_sample(spark):
    df = spark.createDataFrame([(1, "a")] * 9, "id long, s string")
    assert samples.stratified(df, ["s"], ["id"], 4).count() == 4 and samples.shares(df, ["s"], ["id"], 0.5).count() == 5
    assert samples.stratified(df.limit(0), ["s"], ["id"], 4).count() == 0 == samples.shares(df.limit(0), ["s"], ["id"], 0.5).count()


def test_sketches_unite_without_the_rows(spark):
    df = spark.range(20_000).selectExpr("CAST(id % 20 AS int) AS day", "CASE WHEN id % 4 = 0 THEN 'hot' ELSE concat('i', id % 3000) END AS item").unionByName(spark.createDataFrame([(3, None)], "day int, item string"))
    tables = sketches.frequencies_by(df, F.col("day"), "item")
    assert tables.groupBy("period").count().agg(F.max("count")).first()[0] <= sketches.DEPTH * sketches.WIDTH
    span, exact = tables.filter("period BETWEEN 2 AND 11"), df.filter("day BETWEEN 2 AND 11").groupBy("item").count()
    found = sketches.estimated(span, exact.filter("item IS NOT NULL")).join(exact, "item").collect()
    assert all(r.estimate >= r["count"] for r in found) and sum(r.estimate > r["count"] + sketches.slack() * r.total for r in found) <= len(found) * 0.01
    assert [r.item for r in sketches.heavy(span, sketches.frequent_by(df, F.col("day"), "item", 0.05), 0.2).collect()] == ["hot"]
    one = sketches.united(sketches.distinct_by(df, F.col("day"), "item").filter("period < 10")).first()
    n = df.filter("day < 10").select("item").na.drop().distinct().count()
    assert abs(one.hll - n) < 0.05 * n and abs(one.theta - n) < 0.05 * n
