"""Archives and their index: read back by plain gzip, searched key by key, held against a plain grouping and SQL."""

import base64
import gzip
import hashlib
import os
import uuid

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.common import shared_folder
from tessera.llm.queries import ORACLES, QUERIES

PAGES = "page_id long, url string, html string, key string"
BIG = "<p>" + "Straße \U0001f600 " * 200_000 + "</p>"
ROWS = [
    (5, "https://www.Example.org/a b?x=1#top", "<p>one</p>", "k"),
    (3, "http://example.org:8080/a", "<p>one</p>", "k"),
    (9, "http://user@example.org/é", "<p>one</p>", "k"),
    (None, "http://example.com", "<p>one</p>", None),
    (4, "http://example.com/", None, "k"),
    (2, None, "", "k"),
    (8, "no host", "line\r\n\r\nline\r\n\r\n", "k"),
    (7, "http://[::1]:80/x\r\nWARC-Type: request", BIG, "k"),
    (7, "http://[::1]:80/x\r\nWARC-Type: request", BIG, "k"),
    (None, "http://example.net/alone", "only here", "k"),
    (1, "", "last", "k"),
]


def folder(spark):
    return f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"


def plain(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by grouping in a dict."""
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    first = {}
    for i, _, html, *_ in rows:
        if i is not None:
            data = (html or "").encode()
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        again = len(data) >= least and data in first and (i is None or i > first[data])
        out.append((i, len(data), sha(data), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=repr)


def told(df):
    return sorted(((None if r.id is None else int(r.id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_every_page_is_read_back(spark, least):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    archive = warc.write(pages, folder(spark), least=least, block=2, archive_bytes=3000)
    read = archive.read(archive.find(pages))
    assert told(read) == plain(ROWS, least)
    kept = {bytes(r.payload) for r in read.filter("record_type = 'response'").collect()}
    assert kept == {(h or "").encode() for _, _, h, _ in ROWS}
    assert told(warc.open_archive(spark, archive.folder).read(archive.find(pages), payload=False)) == plain(ROWS, least)


def test_archives_are_members_that_any_reader_takes(spark):
    archive = warc.write(spark.createDataFrame(ROWS, PAGES), folder(spark), date="2024-01-31T00:00:00Z")
    path = archive.folder.removeprefix("file://")
    kinds = []
    for name in (n for n in os.listdir(path) if n.endswith(".warc.gz")):
        data = gzip.open(f"{path}/{name}").read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(headers["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n" and headers["WARC-Date"] == "2024-01-31T00:00:00Z"
            kinds.append(headers["WARC-Type"])
            data = rest[n + 4 :]
    assert kinds.count("response") + kinds.count("revisit") == len(ROWS) and kinds.count("revisit") == 4


def test_keys():
    assert warc.surt("https://u:p@WWW.Example.org:81/a b?q#f") == "org,example,www:81)/a%20b?q"
    assert warc.surt("http://example.com") == warc.surt("https://example.com/") == "com,example)/"
    assert warc.surt(None) == "" and warc.surt("x y") == ")x%20y" and warc.surt("") == ")"
    assert warc.page_of(warc.record_id("a:b c", "AAAA")) == "a:b c" and warc.page_of(warc.record_id(None, "AAAA")) is None and warc.page_of(warc.record_id("", "A")) == ""


def test_lookups_read_few_blocks_and_one_hot_key_spans_files(spark):
    """A url with a third of all captures lies in several files; every other key costs at most two blocks."""
    pages = spark.range(3000).selectExpr("id AS page_id", "if(id % 3 = 0, 'http://hot.org/x', concat('http://h', id % 500, '.org/', id)) AS url", "concat('page ', id) AS html")
    archive = warc.write(pages, folder(spark), block=16)
    hot = archive.find(spark.createDataFrame([("http://hot.org/x",)] * 3, "url string"))
    assert hot.count() == 1000 and len(warc.files_of("org,hot)/x", [f["first"] for f in archive.files], [f["last"] for f in archive.files])) > 1
    assert archive.find(spark.createDataFrame([("http://nowhere.org/",), ("http://zzz.zz/",), (None,)], "url string")).count() == 0
    place, root = warc.store(archive.folder)
    names, firsts, lasts = ([f[c] for f in archive.files] for c in ("file", "first", "last"))
    key = warc.surt("http://h7.org/7")
    index = warc.IndexFile(place, f"{root}/{names[warc.files_of(key, firsts, lasts)[0]]}")
    assert len(list(index.find(key))) == 1 and index.reads <= 2 and sum(f["blocks"] for f in archive.files) > 150
    assert {r.id for r in archive.read(hot, payload=False).collect()} == {str(k) for k in range(0, 3000, 3)}


def test_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    archive = warc.write(pages, folder(spark))
    assert archive.files == () and archive.read(archive.find(pages)).count() == 0


def test_text_ids_and_damage(spark):
    pages = spark.createDataFrame([("b/1", "http://x.org", "same"), ("a:0", "http://y.org", "same")], "name string, at string, body string")
    archive = warc.write(pages, folder(spark), id_col="name", url_col="at", html_col="body")
    got = {r.id: (r.record_type, r.refers_to) for r in archive.read(archive.find(pages, "at")).collect()}
    assert got == {"a:0": ("response", None), "b/1": ("revisit", "a:0")}
    data, _ = warc.record("1", "http://x.org", b"body", None, None, "2024-01-31T00:00:00Z")
    other = gzip.compress(gzip.decompress(data).replace(b"body", b"bodx"))
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(other)
    assert warc.parsed(data)[1:] == (4, warc.digest_of(b"body"), b"body")


def test_stretches():
    assert list(warc.stretches([(0, 5), (5, 5), (12, 1)])) == [[(0, 5), (5, 5)], [(12, 1)]]
    assert [len(x) for x in warc.stretches([(k * warc.READ, warc.READ) for k in range(3)])] == [1, 1, 1]
    assert isinstance(pa.array([1]), pa.Array)


def test_query_against_sql(spark):
    engine = duckdb.connect()
    engine.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = engine.sql(ORACLES["op12_warc"])
    got = QUERIES["op12_warc"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes)["page_id"] == dict(got.dtypes)["refers_to"] == "bigint"
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, want.select(*map(duckdb.ColumnExpression, order)).fetchall()))


def test_sql_of_copies(spark, tmp_path):
    """The SQL and the operator agree on copies, empty payloads and rows without an html."""
    rows = [(k, f"http://h{k % 3}.org/{k}", [None, "", "a", "b", f"own {k}"][k % 5]) for k in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    engine = duckdb.connect()
    engine.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(map(repr, engine.sql(ORACLES["op12_warc"]).fetchall()))
    got = QUERIES["op12_warc"](spark, f"file://{tmp_path}").select(*engine.sql(ORACLES["op12_warc"]).columns)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want and got.filter(F.col("record_type") == "revisit").count() == 79 + 39 + 39
