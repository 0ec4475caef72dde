"""Ids and decoded texts against the public tokenizers library."""

import hashlib
import json
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe
from tessera.llm.queries import op7_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Hello  world's\t\n\n x", "\r\n \x0b\x1c\x85\xa0　z", "naïve Straße 👍🏽 ½ Ⅷ ² 一二", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>",
    "<|endoftext", "x" * 3000, "ab" * 700, " " * 900, "é" * 600, "don't I'LL we've 'S", "123 45_67__ $$$ ###a", "́combining ​ zero", "\U000e0001 tag", "thnttionwh " * 200,
]


def expected(text):
    t = Tokenizer.from_file(PATH)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_matches_the_library(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (3, "again"), (3, "again")], "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS decoded")
    rows = bpe.encode(df, PATH, decoded=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for row in rows:
        text = "again" if row.doc_id == 3 and len(row.decoded) > 1 else TEXTS[row.doc_id]
        ids, decoded = expected(text)
        assert list(bpe.unpack(bytes(row.ids))) == ids, text
        assert row.decoded == decoded
    again = bpe.decode(bpe.encode(df.filter("doc_id != 3"), PATH), PATH)
    assert {r.doc_id: r.decoded for r in again.collect()} == {i: expected(t)[1] for i, t in enumerate(TEXTS) if i != 3}


def test_long_and_short_merges_agree():
    codec = bpe.Codec(bpe.read_vocabulary(PATH))
    for text in filter(None, TEXTS):
        parts = [codec.first[b] for b in text.encode()]
        assert codec.merge([*parts]) == codec.merge_long([*parts])


def test_ids_that_are_no_text(spark):
    df = spark.createDataFrame([(1, bytearray(bpe.pack([200, 201]))), (2, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got[2] == "" and got[1] == Tokenizer.from_file(PATH).decode([200, 201])


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op7_bpe(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    t = Tokenizer.from_file(PATH)
    for d in docs:
        ids = t.encode(d.text, add_special_tokens=False).ids
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_one_very_long_text(spark):
    text = ("Ein Satz, 12 Zahlen und " + "x" * 300 + " é👍\n\n  ") * 2000 + "ab" * 5000
    row = bpe.encode(spark.createDataFrame([("an id", text)], "doc_id string, text string"), PATH, decoded=True).first()
    ids, decoded = expected(text)
    assert row.doc_id == "an id" and list(bpe.unpack(bytes(row.ids))) == ids and row.decoded == decoded == text


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.load(open(PATH))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(bpe.UnsupportedTokenizer):
            bpe.read_vocabulary(str(tmp_path / "t.json"))
    with pytest.raises(bpe.UnsupportedTokenizer):
        bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, decoded=True).count() == 0


def test_long_pre_tokens_arent_remembered():
    codec = bpe.Codec(bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    for k in range(20):
        codec.encode("x" * 5000 + str(k) + "short")
    assert max(len(t.encode()) for t in codec) <= bpe.LONG


def test_a_changed_file_is_read_anew(spark, tmp_path):
    """Workers are used again; the tables that they keep are told by the file's content."""
    said = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    path, docs = tmp_path / "t.json", spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    path.write_text(json.dumps(said))
    before = bpe.digests(bpe.encode(docs, str(path), decoded=True)).first()
    said["model"]["merges"] = []
    path.write_text(json.dumps(said))
    after = bpe.digests(bpe.encode(docs, str(path), decoded=True)).first()
    assert after.n_tokens == len("hello there") > before.n_tokens and after.decoded_sha256 == before.decoded_sha256
