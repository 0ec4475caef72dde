"""Statistics against plain counts; learned rules on labels they weren't learned from."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality_rules as q
from tessera.llm.queries import op10_quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    inside = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


TEXTS = [None, "", " \n\t", "a", "a a a a a", "a b a b a b", "x y z q x y z", "é à é à é à 👍 #|<", "l\nl\n l\n\nl", "a b c\nd e f\na b c d e f", "w\x0bw\x1cw w w", "k " * 5000, "a b c " * 400 + "d e f"]


def test_statistics(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (1, "q"), (1, "q")], "doc_id long, text string").selectExpr("*", "'x' AS n_words", "1 AS w", "2 AS l")
    rows = q.statistics(df).collect()
    assert len(rows) == len(TEXTS) + 2
    got = {r.doc_id: tuple(r[c] for c in q.BASE) for r in rows if r.doc_id != 1}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS) if i != 1}


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op10_quality_rules(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == len(docs)
    for d in docs:
        n = brute(d.text)
        r = rows[d.doc_id]
        assert tuple(r[c] for c in q.BASE) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and (not r.base_failed or not r.kept)
    sound = [i for i in labels if not rows[i].base_failed]
    assert np.mean([rows[i].kept == (labels[i] == 1) for i in sound]) > 0.97


def test_rules_hold_on_other_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rules = q.learn(*q.labelled(docs, labels.filter(~held), 1500))
    x, y = q.labelled(docs, labels.filter(held), 2000)
    rejected = np.any([q.holds(r, x) for r in rules], axis=0)
    assert np.mean(rejected[y == 0]) > 0.95 and np.mean(rejected[y == 1]) < 0.02


def test_conjunctions_are_grown_and_pruned(spark):
    """Labels that no single threshold tells: bad where three statistics lie in a box, or two others in another."""
    rng = np.random.default_rng(3)
    x = rng.random((6000, len(q.FEATURES)))
    bad = (x[:, 0] >= 0.5) & (x[:, 1] <= 0.5) & (x[:, 2] >= 0.5) | (x[:, 3] <= 0.25) & (x[:, 4] >= 0.7)
    rules = q.learn(x, np.where(bad, 0, 1), precision=0.9)
    assert max(map(len, rules)) >= 2
    found = lambda z: np.any([q.holds(r, z) for r in rules], axis=0)
    fresh = rng.random((6000, len(q.FEATURES)))
    truth = (fresh[:, 0] >= 0.5) & (fresh[:, 1] <= 0.5) & (fresh[:, 2] >= 0.5) | (fresh[:, 3] <= 0.25) & (fresh[:, 4] >= 0.7)
    assert found(fresh)[truth].mean() > 0.8 and found(fresh)[~truth].mean() < 0.05
    # the conditional expression gives the number of the first rule that holds
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(fresh[:400])], ["i", *q.FEATURES])
    got = {r.i: r.rule for r in rows.select("i", q.verdict(rules).alias("rule")).collect()}
    first = lambda k: next((n for n, r in enumerate(rules, 1) if q.holds(r, fresh[k : k + 1])[0]), 0)
    assert got == {k: first(k) for k in range(400)}
    padded = [*rules[0], (5, ">=", 0.0)]
    assert q.prune(padded, x, bad) == q.prune(rules[0], x, bad)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "w " * 10 + " ".join(map(str, range(60))))], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rules = q.learn(*q.labelled(docs, labels, 10))
    assert rules == [] and q.judge(docs, rules).first().kept
    assert q.judge(docs.limit(0), rules).count() == 0
