"""Posteriors and scores against a plain recomputation; accuracy on labels that weren't learned from."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality_bayes as q
from tessera.llm.queries import op6_quality_bayes
from tessera.llm.quality_rules import FEATURES, features, statistics


def plain_strength(groups, rates):
    """groups: {key: (labels, good)}; rates: what each group's prior says."""
    total = sum(n for n, _ in groups.values())
    m = sum(g for _, g in groups.values()) / total
    spread = sum(n * (g / n - rates[k]) ** 2 for k, (n, g) in groups.items())
    pairs = total - sum(n * n for n, _ in groups.values()) / total
    variance = (spread - len(groups) * m * (1 - m)) / pairs if pairs > 0 else 0
    return min(max(m * (1 - m) / variance - 1, 1.0), 10_000.0) if variance > 0 else 10_000.0


def plain(docs, labels, model):
    """{row: (host rate, path rate, score)} from docs (id, host, path, features) and labels (id, label), in plain Python."""
    paths, own = {}, {}
    for i, label in labels:
        n, g = own.get(i, (0, 0))
        own[i] = (n + 1, g + label)
    for i, host, path, _ in docs:
        if i in own and i is not None:
            n, g = paths.get((host, path), (0, 0))
            paths[host, path] = (n + own[i][0], g + own[i][1])
    hosts = {}
    for (host, _), (n, g) in paths.items():
        a, b = hosts.get(host, (0, 0))
        hosts[host] = (a + n, b + g)
    rate = (sum(g for _, g in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    of_host = plain_strength(hosts, dict.fromkeys(hosts, rate))
    rates = {h: (g + of_host * rate) / (n + of_host) for h, (n, g) in hosts.items()}
    of_path = plain_strength(paths, {k: rates[k[0]] for k in paths})
    out = []
    mean, scale, slopes, bias = model
    for i, host, path, x in docs:
        c, y = own.get(i, (0, 0)) if i is not None else (0, 0)
        n, g = hosts.get(host, (0, 0))
        h = (g - y + of_host * rate) / (n - c + of_host)
        n, g = paths.get((host, path), (0, 0))
        p = (g - y + of_path * h) / (n - c + of_path)
        z = bias + sum(s * (math.log1p(v) - m) / d for s, v, m, d in zip(slopes, x, mean, scale)) + math.log(p / (1 - p)) - math.log(rate / (1 - rate))
        out.append((i, h, p, 1 / (1 + math.exp(-z))))
    return out


def test_matches_plain_recomputation(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    extra = spark.createDataFrame([(None, "no id", None, "en"), (5, "an id again", "src1", None), (5, "", None, None)], "doc_id long, text string, source string, lang string")
    docs = docs.select("doc_id", "text", "source", "lang").union(extra)
    labels = labels.select("doc_id", "quality").union(spark.createDataFrame([(5, 1), (5, 0), (7, None), (None, 1)], "doc_id long, quality int"))
    model = q.fit(docs.select("doc_id", "text"), labels)
    stats = features(statistics(docs, "doc_id", "text", "source", "lang")).collect()
    want = plain([(r.doc_id, r.source, r.lang, [r[f] for f in FEATURES]) for r in stats], [(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None], model)
    got = [(r.doc_id, r.host_rate, r.path_rate, r.score) for r in q.classify(docs, labels, F.col("source"), F.col("lang")).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, *map(lambda x: round(x, 9), r[1:]))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[0] for r in got] == [r[0] for r in want] and np.allclose([r[1:] for r in got], [r[1:] for r in want], atol=1e-9)


def test_own_label_is_left_out(spark):
    docs = spark.createDataFrame([(k, "some words", f"host {k}") for k in range(40)] + [(99, "some words", "host 0")], "doc_id long, text string, host string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in q.classify(docs, labels, F.col("host"), F.lit("/")).collect()}
    # the only label of a host is its document's: nothing is left that tells these apart
    assert len({(round(r.path_rate, 12), round(r.score, 12)) for i, r in rows.items() if i != 99}) == 1
    assert rows[99].path_rate < rows[0].path_rate


def test_sites_of_urls(spark):
    urls = ["https://www.Example.org/en/news/1.html?x=1", "http://m.example.com", "http://a.b/x", "not a url", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(q.host_of(F.col("url")), q.path_of(F.col("url")), q.path_of(F.col("url"), 2))
    assert [tuple(r) for r in df.collect()] == [("example.org", "/en", "/en/news"), ("m.example.com", "/", "/"), ("a.b", "/", "/"), (None, None, None), (None, None, None)]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    kept = q.classify(docs, labels.filter(~held), F.col("source"), F.col("lang"), 2000)
    rows = kept.join(labels.filter(held), "doc_id").collect()
    right = np.array([[r.kept == (r.quality == 1), r.quality] for r in rows])
    assert right[right[:, 1] == 1, 0].mean() > 0.98 and right[right[:, 1] == 0, 0].mean() > 0.9


def test_query_on_whole_table(spark):
    rows = op6_quality_bayes(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == list(range(1000)) and all(0 <= r.score <= 1 for r in rows)


def test_nulls_repeats_and_no_labels(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "s"), (2, "", "s"), (3, "a b c " * 60_000, "s")], "doc_id long, text string, source string").selectExpr("*", "1 AS host", "2 AS n", "3 AS label", "4 AS site")
    got = q.classify(df, spark.createDataFrame([], "doc_id long, quality int"), F.col("source"), F.lit("x"), 10).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 2, 3] and all(abs(r.score - 0.5) < 1e-9 and r.kept for r in got)
    assert q.classify(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), F.col("source"), F.lit("x"), 10).count() == 0
