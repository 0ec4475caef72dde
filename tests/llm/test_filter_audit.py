"""The audit of filters against a plain walk of every document through every order."""

import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tessera.llm import filter_audit
from tessera.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, LONG, "en", "a"),
    (2, LONG, "en", "a"),
    (3, LONG, "de", "b"),
    (4, "one two", "en", "a"),
    (5, "one two", "en", None),
    (6, None, "en", ""),
    (7, "", "en", "b"),
    (8, "SHOUT " * 80, "en", "b"),
    (9, LONG + " 50 %", "en", "a"),
    (9, LONG + " 50 %", "en", "a"),
    (None, LONG, "en", "a"),
    (None, None, None, None),
    (10, "x " * 30_000 + "\U0001f600 $", "en", "b"),
    (11, "Él ÀB AB", "es", "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (9, 1, 0), (9, 0, 1), (8, 0, 1), (None, 1, 1), (77, 1, 1), (4, None, None)]


def fails(i, text, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows))
    return {f for f, hit in zip("ABCDE", found) if hit}


def walked(rows, labels):
    """Every document through every order, one step at a time."""
    out = {}
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    for i, text, _, source in rows:
        failed = fails(i, text or "", rows)
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                r = out.setdefault((source or "", "".join(order), step), dict.fromkeys(filter_audit.COUNTS, 0))
                removed = f in failed and not gone
                r["redundant"] += f in failed and gone
                r["unique_fails"] += failed == {f}
                r["removed"] += removed
                r["good_lost"] += removed and i in good and i is not None
                r["toxic_lost"] += removed and i in toxic and i is not None
                gone = gone or removed
                r["kept"] += not gone
    for (part, order, step), r in out.items():
        r["shapley"] = sum(x["removed"] for (p, o, s), x in out.items() if p == part and o[s - 1] == order[step - 1])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): {c: r[c] for c in filter_audit.COUNTS} for r in df.collect()}


def test_every_order_as_walked(spark):
    docs = spark.createDataFrame(ROWS, DOCS).withColumnsRenamed({"lang": "mask"})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    counts = filter_audit.histograms(filter_audit.masks(docs), labels)
    got, want = found(filter_audit.audit(counts)), walked(ROWS, LABELS)
    assert len(got) == 4 * 600 and got == want


def test_empty_table(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.histograms(filter_audit.masks(docs), labels)).count() == 0


def test_matrices_partition_the_masks():
    """At each step a document is kept, removed now, or was removed earlier."""
    columns, by = filter_audit.outcomes("ABCDE")
    assert len(columns) == 600 and by["kept"].shape == (32, 600)
    assert ((by["kept"] + by["removed"] + by["redundant"]) <= 1).all() and (by["unique"] <= by["removed"]).all()
    # each filter's removals over all orders share a document out among the filters that it fails
    for mask in range(1, 32):
        assert by["removed"][mask].sum() == 120
    assert np.array_equal(by["removed"][31], np.array([s == 1 for _, s in columns]))


def test_more_parts_than_are_multiplied_at_once(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('word ', id) AS text", "concat('s', id % 150) AS source")
    counts = filter_audit.histograms(filter_audit.masks(docs), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = filter_audit.audit(counts)
    assert got.count() == 150 * 600 and got.filter("step = 5").agg({"kept": "sum"}).first()[0] == 0


@pytest.mark.parametrize("name", ["op13_filter_audit"])
def test_query_against_sql(spark, name):
    engine = duckdb.connect()
    for t in ("documents", "labels"):
        engine.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = engine.sql(ORACLES[name])
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(want.order("1").select(*[duckdb.ColumnExpression(c) for c in order]).fetchall())
