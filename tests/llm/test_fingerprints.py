"""Edited texts against plain slicing; votes and the search against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp
from tessera.llm.minhash import near_duplicates
from tessera.llm.queries import op3_fingerprints


def brute_edited(docs):
    docs = sorted(docs)
    out = {}
    for k, (i, text) in enumerate(docs):
        following, half = docs[(k + 1) % len(docs)][1] or "", len(text or "") // 2
        text = text or ""
        out[i] = text[: len(text) - half] + following[:half]
    return out


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in op3_fingerprints(spark, folder).collect()}
    want = brute_edited(docs)
    assert len(rows) == len(docs)
    for i, text in docs:
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
    by_text = {}
    for i, text in docs:
        assert by_text.setdefault(text, rows[i].fingerprint) == rows[i].fingerprint
    order = sorted(rows)
    bits = lambda x: int(x, 16)
    for a, b in zip(order, [*order[1:], order[0]]):
        assert abs(rows[a].near_next - (1 - (bits(rows[a].fingerprint) ^ bits(rows[b].fingerprint)).bit_count() / 128)) < 1e-12
        assert abs(rows[a].near_edited - (1 - (bits(rows[a].fingerprint) ^ bits(rows[a].edited_fingerprint)).bit_count() / 128)) < 1e-12
    nearer = [r.near_edited > r.near_next for r in rows.values() if r.n_chars > 300]
    assert np.mean(nearer) > 0.98


def test_votes_by_hand(spark):
    text = "The cat, the CAT and a Dog ünd\n"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    terms = df.select(F.explode(fp.terms(F.col("text"))).alias("t")).select("t", fp.weight(F.col("t")), *fp.hashes(F.col("t"))).collect()
    assert [r[0] for r in terms] == ["the", "cat,", "the", "cat", "and", "a", "dog", "ünd"]
    half = []
    for k in (2, 3):
        total = sum(r[1] for r in terms)
        bits = sum(1 << b for b in range(64) if 2 * sum(r[1] for r in terms if r[k] >> b & 1) > total)
        half.append(bits - (1 << 64) * (bits >> 63))
    got = fp.fingerprints(df).first()
    assert [got.f1, got.f2] == half


def test_search_matches_brute_force(spark):
    rng = random.Random(1)
    seeds = [rng.getrandbits(128) for _ in range(60)]
    found = seeds + [s ^ sum(1 << b for b in rng.sample(range(128), k)) for s in seeds for k in (1, 2, 3, 4, 5)] + seeds[:9]
    signed = lambda x: x - (1 << 64) * (x >> 63)
    df = spark.createDataFrame([(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in found], "f1 long, f2 long")
    for radius in (0, 1, 3, 6):
        got = {frozenset(((r.f1, r.f2), (r.g1, r.g2))) for r in fp.within(df, radius).collect()}
        key = lambda x: (signed(x >> 64), signed(x & (1 << 64) - 1))
        distinct = sorted(set(found))
        assert got == {frozenset((key(a), key(b))) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= radius}


def test_both_fingerprints_are_those_of_whole_texts(spark):
    rng = random.Random(3)
    texts = ["", " ", "a", "ab cd", "ab  cd\n", "longword" * 9, "x\ty\x0bz w", "é ü ñ", " lead and trail  ", "cut in\rmiddle words here"]
    texts += ["".join(rng.choice("abcé \n\t") for _ in range(rng.randrange(80))) for _ in range(60)]
    docs = list(enumerate(texts))
    whole = spark.createDataFrame([*docs, *((1000 + i, t) for i, t in brute_edited(docs).items())], "doc_id long, text string")
    want = {r.doc_id: (r.f1, r.f2) for r in fp.fingerprints(whole).collect()}
    got = fp.with_edited(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    assert all((r.f1, r.f2) == want[r.doc_id] and (r.e1, r.e2) == want[1000 + r.doc_id] for r in got)


def test_recall_of_linked_documents_by_radius(spark):
    """Of the documents that five-word shingles link to a text of another fingerprint, those whose fingerprints the search finds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = fp.fingerprints(docs).cache()
    key = {r.doc_id: (r.f1, r.f2) for r in found.collect()}
    linked = {frozenset((key[r.doc_id], key[r.component_id])) for r in near_duplicates(docs).collect() if key[r.doc_id] != key[r.component_id]}
    met = {radius: {frozenset(((r.f1, r.f2), (r.g1, r.g2))) for r in fp.within(found, radius).collect()} for radius in (fp.RADIUS, 16)}
    assert linked and len(linked & met[16]) >= 0.9 * len(linked)
    assert linked & met[fp.RADIUS] == {p for p in linked if fp_distance(*p) <= fp.RADIUS}


def fp_distance(a, b):
    return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(fp, "CROWD", 7)
    rng = random.Random(2)
    seed = rng.getrandbits(128)
    found = sorted({seed ^ sum(1 << b for b in rng.sample(range(128), k)) for k in (1, 1, 2, 2, 2, 3) for _ in range(40)} | {seed})
    signed = lambda x: x - (1 << 64) * (x >> 63)
    key = {(signed(x >> 64), signed(x & (1 << 64) - 1)): x for x in found}
    df = spark.createDataFrame([*key, *list(key)[:30]], "f1 long, f2 long")
    got = {key[r.f1, r.f2]: (r.n_within, r.nearest) for r in fp.neighbours(df, 3).collect()}
    near = {x: [d for y in found if x != y and (d := (x ^ y).bit_count()) <= 3] for x in found}
    assert got == {x: (len(n), min(n)) for x, n in near.items() if n}
    # a hot fingerprint's rows are dealt to parts, others' aren't
    rows = [(i, *k) for i, k in enumerate([*key, *[list(key)[3]] * 200])]
    table = spark.createDataFrame(rows, "doc_id long, f1 long, f2 long")
    assert [r.shares for r in fp.hot_fingerprints(table).collect()] == [fp.SHARES]
    all_rows = fp.with_neighbours(table, 3).collect()
    assert sorted(r.doc_id for r in all_rows) == list(range(len(rows)))
    assert all((r.n_within, r.nearest) == (len(n := near[key[r.f1, r.f2]]), min(n, default=None)) for r in all_rows)


def test_search_of_the_query_matches_all_pairs(spark):
    rows = op3_fingerprints(spark, "/root/testdata/sf0.01").collect()
    found = {int(r.fingerprint, 16) for r in rows}
    near = {x: [d for y in found if x != y and (d := (x ^ y).bit_count()) <= fp.RADIUS] for x in found}
    assert any(near.values())
    assert all((r.n_within, r.nearest) == (len(n := near[int(r.fingerprint, 16)]), min(n, default=None)) for r in rows)


def test_nulls_ties_and_small_tables(spark):
    rows = [(1, None), (2, ""), (3, "a"), (5, "one two three"), (5, "one two three"), (9, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS edited", "2 AS id", "3 AS row")
    got = fp.compare(fp.with_edited(df)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 5, 5, 9]
    assert len({tuple(r) for r in got if r.doc_id == 5}) == 1
    assert {r.doc_id: r.n_chars for r in got} == {1: 0, 2: 0, 3: 1, 5: 13, 9: 50_000}
    one = fp.compare(fp.with_edited(df.filter("doc_id = 3"))).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    nameless = spark.createDataFrame([(None, "abcd"), (7, "wxyz")], "doc_id long, text string")
    assert {r.doc_id: r.edited_sha256 for r in fp.compare(fp.with_edited(nameless)).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in ((None, "abwx"), (7, "wxab"))}
    assert fp.compare(fp.with_edited(df.limit(0))).count() == 0


def test_repeated_ids_compare_the_row_that_is_copied(spark):
    texts = [f"words {'of many kinds ' * k} end {k}" for k in range(9)]
    df = spark.createDataFrame([(1, texts[8]), *((2, t) for t in texts[:8])], "doc_id long, text string")
    row = {r.doc_id: r for r in fp.compare(fp.with_edited(df)).filter("doc_id = 1").collect()}[1]
    least = df.filter("doc_id = 2").orderBy(F.xxhash64("text")).first().text
    half = len(texts[8]) // 2
    assert row.edited_sha256 == hashlib.sha256((texts[8][: len(texts[8]) - half] + least[:half]).encode()).hexdigest()
    alone = {r.text: (r.f1, r.f2) for r in fp.fingerprints(df, "text").join(df.select("text").distinct(), "text").collect()}
    bits = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(alone[texts[8]], alone[least]))
    assert abs(row.near_next - (1 - bits / 128)) < 1e-12


def test_fingerprints_of_the_query_match_a_plain_vote(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy(F.length("text")).limit(60)
    terms = docs.select("doc_id", F.explode(fp.terms(F.col("text"))).alias("t")).select("doc_id", fp.weight(F.col("t")).alias("w"), *(h.alias(f"h{k}") for k, h in enumerate(fp.hashes(F.col("t"))))).collect()
    got = {r.doc_id: int(r.fingerprint, 16) for r in op3_fingerprints(spark, folder).collect()}
    for i in {r.doc_id for r in terms}:
        of, want = [r for r in terms if r.doc_id == i], 0
        for h in ("h0", "h1"):
            want = want << 64 | sum(1 << b for b in range(64) if 2 * sum(r.w for r in of if r[h] >> b & 1) > sum(r.w for r in of))
        assert got[i] == want


@pytest.fixture
def small_broadcasts(spark):
    """Tables that Spark sizes at 400 kB are broadcast, tables that have 2 MB can't be."""
    limits = {"spark.sql.autoBroadcastJoinThreshold": "400k", "spark.sql.maxBroadcastTableSize": "2m"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k in limits:
        spark.conf.unset(k)


def test_entries_of_all_tables_are_not_broadcast(spark, small_broadcasts):
    """5,000 fingerprints, sized at 180 kB, have 140,000 entries of 40 bytes in the tables."""
    rng = random.Random(5)
    seeds = [rng.getrandbits(128) for _ in range(2_500)]
    signed = lambda x: x - (1 << 64) * (x >> 63)
    key = lambda x: (signed(x >> 64), signed(x & (1 << 64) - 1))
    found = fp.written(spark.createDataFrame([key(x) for s in seeds for x in (s, s ^ 1 << rng.randrange(128))], "f1 long, f2 long"), "test")
    got = fp.neighbours(found).collect()
    assert len(got) == 5_000 and {(r.n_within, r.nearest) for r in got} == {(1, 1)}
    assert {r.distance for r in fp.within(found).collect()} == {1} and fp.within(found).count() == 2_500


def test_texts_that_files_hold_compressed_are_not_broadcast(spark, small_broadcasts):
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat(concat('word ', id % 7, ' '), 1000) AS text")
    rows = fp.compare(fp.with_edited(fp.written(docs, "test"))).collect()
    assert len(rows) == 600 and {r.n_chars for r in rows} == {7_000}


def test_fingerprints_of_copies_are_not_broadcast(spark, small_broadcasts):
    """Equal fingerprints take little of a file, but each row of them is one."""
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 8), k -> md5(concat(id % 64, '-', k)))) AS text")
    rows = fp.compare(fp.with_edited(docs))
    assert rows.filter("n_within = 0").count() == 40_000 and rows.select("fingerprint").distinct().count() == 64
