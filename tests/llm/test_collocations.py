"""Collocations against plain counting of every piece, shards of few words, hashes that collide, and SQL."""

import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tessera.llm import collocations
from tessera.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, f long, phrase string"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, text, lang, 1, "x") for k, (text, lang) in enumerate(rows)], DOCS)


def plain(rows, least=10, longest=3, top=2000, share=50):
    """Every contiguous phrase of every piece, counted in a dict."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= least}
    out = {}
    for (g, p), a in candidates.items():
        inside = (b for (h, q), b in candidates.items() if h == g and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if any(100 * b >= share * a for b in inside):
            continue
        cuts = [(Fraction(10**6 * a * a, f[g, p[:k]] * f[g, p[k:]]).__floor__(), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(g, []).append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    return sorted((g, r, p.decode(), -a, left, right, n[g], -s) for g, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def told(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made(seed, texts=300, vocabulary=5, langs=("en", "de", None, "und", "é")):
    at = random.Random(seed)
    words = [f"W{k}" if k % 3 else f"ß{k}\U0001f600" for k in range(vocabulary)] + ["a\x00b", "-", " "]
    rows = [("".join(at.choice(words) + at.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? ", "\r\n"]) for _ in range(at.randrange(150))), at.choice(langs)) for _ in range(texts)]
    return [*rows, (None, "en"), ("", "fr"), (" \n. ", None), ("only once here", "it")]


@pytest.mark.parametrize(("seed", "longest"), [(1, 3), (2, 2), (4, 4)])
def test_as_counted_plainly(spark, seed, longest):
    rows = made(seed)
    want = plain(rows, longest=longest)
    got = told(collocations.mine(docs_of(spark, rows).repartition(3), longest=longest))
    assert want and got == want


def test_small_shards_chunks_and_tables(spark, monkeypatch):
    """The results don't depend on where shards and chunks end, nor on a table so full that it prunes nothing."""
    rows = [*made(5, texts=20), ("one two three " * 4000 + ". " + "x y " * 3000, "en")]
    want = plain(rows)
    data = [(lang or "und", (text or "").encode().translate(collocations.FOLD)) for text, lang in rows]
    monkeypatch.setattr(collocations, "CHUNK", 7)
    monkeypatch.setattr(collocations, "SHARD", 300)
    for fill in (0, 255):
        f, table = Counter(), np.full(1 << 24, fill, np.uint8)
        for lang, text in data[:20]:
            for batch in collocations.counted(lang, text, 3, {2: table}):
                f.update(dict(zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist())))
        plainly = Counter()
        for lang, text in data[:20]:
            for piece in text.decode().split("\n"):
                words = [w for w in piece.split(" ") if w]
                plainly.update((lang, " ".join(words[i : i + 3])) for i in range(len(words) - 2))
        assert f == (plainly if fill else Counter())
    monkeypatch.undo()
    assert told(collocations.mine(docs_of(spark, rows))) == want


def test_long_texts_are_cut_at_pieces_only():
    import pyarrow as pa

    text = ("a b c. " * 10 + "d e f g " * 30 + ", ") * 3
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    whole = Counter()
    for b in collocations.counter(2, {})(iter([batch])):
        whole.update(dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist())))
    before, collocations.SHARD = collocations.SHARD, 40
    try:
        cut, shards = Counter(), 0
        for b in collocations.counter(2, {})(iter([batch])):
            cut.update(dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist())))
            shards += "" in b.column(1).to_pylist()
    finally:
        collocations.SHARD = before
    assert cut == whole and shards > 3


def test_products_beyond_64_bits(spark):
    frequent = spark.createDataFrame([("en", "a b", 4 * 10**12), ("en", "a", 5 * 10**12), ("en", "b", 6 * 10**12 + 1)], "lang string, phrase string, f long")
    (row,) = collocations.scored(frequent).collect()
    assert row.score == 10**6 * 16 * 10**24 // (5 * 10**12 * (6 * 10**12 + 1))


def test_ranks_are_cut_after_ties(spark):
    rows = [("b b2. a a2. c c2. " * 10, "en"), ("z y " * 12, "en")]
    want = plain(rows, top=3)
    assert [w[2] for w in want] == ["a a2", "b b2", "c c2"] and told(collocations.mine(docs_of(spark, rows), top=3)) == want


def test_empty_tables_and_bad_lengths(spark):
    assert collocations.mine(docs_of(spark, [])).count() == 0
    assert collocations.mine(docs_of(spark, [(None, None), ("", "en")])).count() == 0
    with pytest.raises(ValueError, match="two words"):
        collocations.mine(docs_of(spark, []), longest=1)


def test_query_against_sql(spark):
    engine = duckdb.connect()
    engine.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = engine.sql(ORACLES["op11_collocations"])
    got = QUERIES["op11_collocations"](spark, "/root/testdata/sf0.001")
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = sorted(tuple(r[c] for c in order) for r in got.collect())
    assert len(rows) > 100 and rows == sorted(want.select(*map(duckdb.ColumnExpression, order)).fetchall())
