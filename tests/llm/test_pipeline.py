"""Each stage of the pipeline against a plain version on its own input."""

import hashlib
import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_minhash import brute

FOLDER = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_toxic_documents_go(spark):
    docs = documents(spark)
    kept = {r.doc_id for r in STAGE["toxicity"](spark, docs, FOLDER).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
    right = sum((i in kept) == (not toxic) for i, toxic in labels.items())
    assert right >= 0.9 * len(labels)


def test_repeated_lines_go(spark):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    often = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")} if k)
    found = STAGE["line dedup"](spark, documents(spark), FOLDER).collect()
    assert {r.doc_id: r.text for r in found} == {i: "\n".join(x for x in t.split("\n") if often[key(x)] < 10) for i, t in docs.items()}
    assert all(r.n_chars == len(r.text) for r in found)


def test_one_of_each_group_stays(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    kept = {r.doc_id for r in STAGE["MinHash near-dedup"](spark, documents(spark), FOLDER).collect()}
    assert kept == {i for i, (_, _, stays) in brute(docs).items() if stays}


def test_sources_come_near_their_targets(spark):
    from tessera.llm import mixing

    docs = {r.doc_id: r for r in documents(spark).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in docs.items()}
    sizes = Counter()
    for i, r in docs.items():
        sizes[r.source] += size[i]
    wanted = mixing.targets(dict(sizes), mixing.by_order()([*sizes]), 1.5, 2)
    rows = STAGE["mixing to target weights"](spark, documents(spark), FOLDER).collect()
    assert all(r == docs[r.doc_id] for r in rows)
    assert max(Counter(r.doc_id for r in rows).values()) <= 2
    got = Counter()
    for r in rows:
        got[r.source] += size[r.doc_id]
    for s in sizes:  # texts aren't cut, so half of the longest may be missing or too much
        assert abs(got[s] - wanted[s]) <= 1 + max(size[i] for i, r in docs.items() if r.source == s) / 2


def test_ids_are_the_tokenizers(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in STAGE["BPE encoding"](spark, documents(spark), FOLDER).collect():
        ids = plain.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == b"".join(i.to_bytes(4, "little") for i in ids)


def test_nulls_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "a few words of text", "en", "a", 19), (None, "other words that are here", "en", None, 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS mix_id", "2 AS tox_score")
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            docs.collect()
    assert {(r.doc_id, r.text) for r in STAGE["mixing to target weights"](spark, df, FOLDER).select("doc_id", "text").collect()} <= {(3, "a few words of text"), (None, "other words that are here")}
    assert STAGE["toxicity"](spark, df, FOLDER).filter(F.col("text").isNull()).count() == 2


def test_ids_are_decoded(spark):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = STAGE["BPE encoding"](spark, documents(spark), FOLDER).collect()
    assert len(rows) == len(docs) and all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in rows)
