"""Targets, flow and the documents taken, against plain versions."""

import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.queries import op8_mixing


def plain_targets(sizes, weights, share, cap):
    """Shares first; then the excess of those above goes to the others, again and again."""
    total = share * sum(sizes.values())
    out, closed = {s: total * weights[s] / sum(weights.values()) for s in sizes}, set()
    while over := [s for s in sizes if s not in closed and out[s] > cap * sizes[s] + 1e-9]:
        excess = sum(out[s] - cap * sizes[s] for s in over)
        closed |= set(over)
        out |= {s: cap * sizes[s] for s in over}
        free = [s for s in sizes if s not in closed]
        for s in free:
            out[s] += excess * weights[s] / sum(weights[x] for x in free)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=7))
def test_targets(found):
    sizes = dict(enumerate(found))
    weights = {s: (5, 2, 1)[s % 3] for s in sizes}
    got, want = mixing.targets(sizes, weights, 1.5, 2), plain_targets(sizes, weights, 1.5, 2)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def best(patterns, quotas, members, repeats):
    """Most words, then the least cost, over all flows of small whole numbers."""
    arcs = [(p, s) for p in patterns for s in members[p]]
    top = (-1, 0)
    for amounts in itertools.product(*(range(min(repeats * patterns[p], quotas[s]) + 1) for p, s in arcs)):
        out = {p: sum(a for a, (q, _) in zip(amounts, arcs) if q == p) for p in patterns}
        into = {s: sum(a for a, (_, q) in zip(amounts, arcs) if q == s) for s in quotas}
        if all(out[p] <= repeats * patterns[p] for p in patterns) and all(into[s] <= quotas[s] for s in quotas):
            top = max(top, (sum(amounts), -sum(max(0, out[p] - patterns[p]) for p in patterns)))
    return top


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=3, max_size=3), st.lists(st.integers(0, 4), min_size=2, max_size=2))
def test_flow_is_largest_and_cheapest(words, quota):
    patterns, quotas = dict(zip("xyz", words)), dict(zip("ab", quota))
    members = {"x": ["a"], "y": ["a", "b"], "z": ["b"]}
    sent = mixing.flow(patterns, quotas, members, 2)
    out = {p: sum(v for (q, _), v in sent.items() if q == p) for p in patterns}
    assert all(sum(v for (_, q), v in sent.items() if q == s) <= quotas[s] for s in quotas)
    assert (sum(sent.values()), -sum(max(0, out[p] - patterns[p]) for p in patterns)) == best(patterns, quotas, members, 2)


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op8_mixing(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken = {}, {}
    for r in rows:
        source = docs[r.doc_id].source
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text)) and 0 <= r.taken <= 2 * r["size"]
        sizes[source] = sizes.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r.taken
    order = sorted(sizes)
    want = plain_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    for r in rows:
        assert r.source_size == sizes[docs[r.doc_id].source] and abs(r.target - want[docs[r.doc_id].source]) < 1e-6 * r.target + 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert {tuple(r) for r in rows} == {tuple(r) for r in op8_mixing(spark, folder).collect()}


def test_overlaps_nulls_and_repeats(spark):
    rows = [(i, i % 5 + 1, ["a", "b"] if i % 3 == 0 else ["a"]) for i in range(60)] + [(7, 3, ["c", None])] * 4 + [(8, 0, [None])]
    df = spark.createDataFrame(rows, "doc_id long, n long, groups array<string>").withColumn("size", F.lit("clash"))
    out, sizes, wanted = mixing.mix(df, F.col("n"), F.col("groups"), mixing.by_order((1, 3)))
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sum(r.taken for r in got) <= sum(round(t) for t in wanted.values())
    empty, _, none = mixing.mix(df.limit(0), F.col("n"), F.col("groups"), mixing.by_order())
    assert empty.count() == 0 and none == {}


def test_repeats_nulls_and_names_at_volume(spark):
    """Thousands of rows without an id, of one id, and alike in all columns; columns of the names that are used inside."""
    text = lambda k: "w " * (k % 4)
    rows = [(None, text(k), "s") for k in range(6000)] + [(5, text(3), "s")] * 4000 + [(5, text(k), "t") for k in range(3000)] + [(k, text(k), None) for k in range(100, 400)] + [(8, None, "s"), (9, "", "t"), (10, "long " * 30_000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS mix_id", "2 AS of", "3 AS size", "4 AS pattern", "5 AS id", "6 AS taken", "7 AS copy").repartition(7)
    size = F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long") - 1
    out, sizes, wanted = mixing.mix(df, size, F.array("source"), mixing.by_order())
    got = out.collect()
    assert len(got) == len(rows)
    for s in sizes:
        assert sum(r.taken for r in got if r.sources == [s]) == round(wanted[s])
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    key = lambda found: sorted(map(str, found))
    again, _, _ = mixing.mix(df.repartition(3), size, F.array("source"), mixing.by_order())
    assert key(again.collect()) == key(got)
    spread = mixing.spread(df, size, F.array("source"), mixing.by_order())
    assert spread.columns == df.columns and spread.filter("mix_id != 1 OR size != 3 OR pattern != 4 OR id != 5").count() == 0


def test_query_with_nulls_and_long_texts(spark, tmp_path):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x " * 50_000, "a"), (4, "y z", None), (None, "q", "b"), (None, "q", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_mixing(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r["size"], r.source_size) for r in got) == [("1", 0, 50_000), ("2", 0, 50_000), ("3", 50_000, 50_000), ("4", 2, 2), ("None", 1, 2), ("None", 1, 2)]
    assert all(r.taken <= 2 * r["size"] for r in got) and [r.taken for r in got if r["size"] == 0] == [0, 0]


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 3)
    df = spark.createDataFrame([(k, 1) for k in range(4)], "doc_id long, n long")
    with pytest.raises(ValueError):
        mixing.mix(df, F.col("n"), F.array("doc_id"), mixing.by_order())
