"""Kept lines against a plain count, over many partitions and hot lines."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

from tessera.llm import line_dedup
from tessera.llm.common import checkpoint_of, checkpointed
from tessera.llm.queries import ORACLES, op2_line_dedup

UP = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(docs, least=10, keep_first=False):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    where, first = defaultdict(set), {}
    for i, text in sorted(docs):
        for k, x in enumerate((text or "").split("\n")):
            where[key(x)].add(i)
            first.setdefault(key(x), (i, k))
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for k, x in enumerate(lines) if not key(x) or (first[key(x)] == (i, k) if keep_first else len(where[key(x)]) < least)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


DOCS = [(i, "\n".join([" Hot Line\t", f"own {i}", "", "hot line", f"shared {i // 9}", f"Shared {i // 10} x", "ÀB"][: 2 + i % 6])) for i in range(300)] + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "z\nz\nz" * 2000)]


@pytest.mark.parametrize("parts", ["1", "3", "40"])
@pytest.mark.parametrize("keep_first", [False, True])
def test_matches_plain_count(spark, parts, keep_first):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS n_lines", "2 AS pos", "'q' AS dropped")
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup(df, keep_first=keep_first).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(DOCS, keep_first=keep_first)


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op2_line_dedup(spark, folder).collect()}
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()])
    assert {i: (r.n_lines, r.n_dropped, r.kept_sha256) for i, r in rows.items()} == {i: (a, b, hashlib.sha256(t.encode()).hexdigest()) for i, (a, b, t) in want.items()}
    assert "op2_line_dedup" in ORACLES


def brute_rows(docs, least=10):
    """A plain count by row: (id, n_lines, n_dropped, text) of each."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    where = defaultdict(set)
    for i, text in docs:
        for x in (text or "").split("\n"):
            where[key(x)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(where[key(x)]) < least]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_null_and_repeated_ids_lose_their_own_lines(spark, tmp_path, kind):
    big = 2**60 if kind == "long" else 0
    docs = [(i + big, f"hot\nown {i}") for i in range(8)] + [(None, "hot\na"), (None, "b\nHot"), (None, "b\nHot"), (8, "c\nd\nhot"), (8, "hot\ne"), (8, None), (8, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text", "3 AS dropped_of", "'q' AS dropped", "4 AS dropped_row", "5 AS Dropped_")
    out = line_dedup.dedup(df)
    assert out.schema["doc_id"].dataType.simpleString().replace("bigint", "long") == kind
    rows = out.collect()
    assert {(r.dropped_of, r.dropped, r.dropped_row, r.Dropped_) for r in rows} == {(3, "q", 4, 5)}
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in rows) == brute_rows(docs)
    # rows of one id are one document: nine of them, though fifteen rows
    assert line_dedup.dedup(df.filter("doc_id IS NULL OR doc_id != 0")).agg({"n_dropped": "sum"}).first()[0] == (13 if kind == "long" else 0)
    copies = df.filter("text LIKE 'b%'")
    assert [r.n_dropped for r in line_dedup.dedup(copies, keep_first=True).collect()] == [0, 0]
    if kind == "long":
        df.write.parquet(f"{tmp_path}/documents.parquet")
        asked = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in op2_line_dedup(spark, str(tmp_path)).collect())
        want = sorted((i, a, b, hashlib.sha256(t.encode()).hexdigest()) for i, a, b, t in brute_rows(docs))
        assert asked == want
        other = duckdb.connect()
        other.sql(f"CREATE VIEW documents AS SELECT doc_id, text FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted((str(i), a, b, t) for i, a, b, t in other.sql(ORACLES["op2_line_dedup"]).fetchall()) == want


def test_empty_table(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_checkpoints_go_with_the_session(spark):
    table = checkpointed(spark.range(5).toDF("id"))
    place = checkpoint_of(table)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(place) and sorted(r.id for r in table.collect()) == list(range(5))
    # true only of a path that is marked
    assert files.cancelDeleteOnExit(place)
    files.deleteOnExit(place)
