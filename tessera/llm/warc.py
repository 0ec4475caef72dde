"""WARC archives of pages, and a capture index over them that is searched before a byte of an archive is read.

Writing: pages with equal payloads are grouped by digest; the one with the least
id is stored as a response, the others as revisits that name it and hold no
payload. Each task appends its records, a gzip member each, to archives of its
own and reports where they lie. What was reported is what counts: files of an
attempt that was lost are named nowhere.

The index has two levels. Lines (reversed-host key, date, place) are dealt by
range and sorted; each range is a file of compressed blocks of ``BLOCK`` lines
beside a sparse directory with the first line and the place of each block. Above
these there is one entry for each file, in a manifest. A lookup goes by binary
search from the manifest to a file, by binary search in its directory to a block,
by binary search in the block to the lines, and by range reads to the records.
Keys and places are dealt out by file, so each block and range is read once.

Archives and index lie in a folder that driver and executors share, of a scheme
that pyarrow opens (file, hdfs, s3, gs and the like).

Cases: a null html is an empty payload; one of no bytes is stored too. Payloads of
less than ``least`` bytes are all responses. Rows without an id are revisits where
a row with an id has their payload, else responses; rows equal in id and payload
are all responses or all revisits and share a record id. A null url is stored as
about:blank under the empty key; signs that a header can't hold are escaped.
Payloads are worked on whole, one at a time. Only the columns named are read. An
empty table makes an archive and an index without entries. A record whose digest
doesn't agree with its payload raises ValueError when it is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Index lines in a compressed block.
BLOCK = 1000
#: An archive that has grown to as many bytes is followed by another.
ARCHIVE_BYTES = 1 << 30
#: Places in an archive that one task reads, and bytes that are read at once.
STRETCH, READ = 1 << 26, 1 << 22
LEVEL = 6
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
CAPTURE = "key string, line string"
PLACE = "file string, offset long, length long"
RECORD = "id string, url string, date string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def printable(url: str) -> str:
    """The url in visible ASCII; what is escaped already stays."""
    return quote(url, safe=PRINTABLE)


def surt(url: str | None) -> str:
    """The key of a url: its host's labels in reverse, port, path and query, without scheme, user and fragment."""
    if url is None:
        return ""
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url := printable(url))
    if not found:
        return ")" + url.partition("#")[0]
    host, colon, port = found[1].rpartition("@")[2].lower().partition(":") if "[" not in found[1] else (found[1].lower(), "", "")
    return ",".join(reversed(host.split("."))) + colon + port + ")" + (found[2] or "/")


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:page-none:{digest}>" if page is None else f"<urn:page:{quote(page, safe='')}:{digest}>"


def page_of(identifier: str | None) -> str | None:
    """The page's id in a record's."""
    found = re.fullmatch(r"<urn:page:([^:]*):[A-Z2-7]*>", identifier or "")
    return unquote(found[1]) if found else None


def member(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    packing = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packing.compress(head.encode() + block + b"\r\n\r\n") + packing.flush()


def record(page: str | None, url: str | None, payload: bytes, first: str | None, first_url: str | None, date: str) -> tuple[bytes, dict]:
    """A page's record, and what the index says of it; a revisit if ``first`` names a response."""
    digest, target = digest_of(payload), "about:blank" if url is None else printable(url)
    kind = "response" if first is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}")]
    if first is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest)), ("WARC-Refers-To-Target-URI", "about:blank" if first_url is None else printable(first_url)), ("WARC-Refers-To-Date", date)]
    return member([*headers, ("Content-Type", "application/http; msgtype=response")], block), {"url": target, "digest": digest, "type": kind}


def grouped(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(id, url, payload, first, first_url): first is the response that a revisit names, null for responses. Copies meet as partial minima of narrow rows; the groups of two and more are written, so that the join broadcasts them only if that table's size allows it."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("sum"))
    copies = rows.filter(F.octet_length("payload") >= least).groupBy("sum").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url")).alias("least"))
    firsts = written(copies.filter("n > 1 AND NOT least.none").select("sum", F.col("least.id").alias("first"), F.col("least.url").alias("first_url")), "firsts")
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    joined = rows.join(firsts, "sum", "left")
    return joined.select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(again, F.col("first").cast("string")).alias("first"), F.when(again, F.col("first_url")).alias("first_url"))


def archiver(folder: str, date: str, archive_bytes: int):
    """Writes (id, url, payload, first, first_url) to archives of the task's own; gives the index lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = store(folder)
        stamp = re.sub("[^0-9]", "", date)[:14]
        out, name, at = None, "", 0
        try:
            for batch in batches:
                keys, lines = [], []
                for k in range(batch.num_rows):
                    page, url, payload, first, first_url = (c[k].as_py() for c in batch.columns)
                    data, entry = record(page, url, payload, first, first_url, date)
                    if out is not None and at + len(data) > archive_bytes:
                        out.close()
                        out = None
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = place.open_output_stream(f"{root}/{name}", compression=None)
                        info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        at = len(info)
                    out.write(data)
                    keys.append(surt(url))
                    lines.append(f"{keys[-1]} {stamp} {json.dumps(entry | {'filename': name, 'offset': at, 'length': len(data)})}")
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], names=["key", "line"])
        finally:
            if out is not None:
                out.close()

    return run


def indexer(folder: str, block: int):
    """Writes sorted lines as compressed blocks and a directory beside them; gives one row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = store(folder)
        name, directory, held, last, at, n = f"{uuid.uuid4().hex}.cdx.gz", [], [], "", 0, 0
        out = None

        def flush() -> None:
            nonlocal at, held, out
            out = out or place.open_output_stream(f"{root}/{name}", compression=None)
            data = gzip.compress("\n".join(held).encode(), mtime=0)
            out.write(data)
            directory.append(f"{held[0].partition(' ')[0]} {at} {len(data)}")
            at += len(data)
            held = []

        for batch in batches:
            for line in batch.column(0).to_pylist():
                held.append(line)
                last, n = line, n + 1
                if len(held) == block:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with place.open_output_stream(f"{root}/{name}.directory", compression=None) as beside:
                beside.write("\n".join(directory).encode())
            row = {"file": name, "first": directory[0].partition(" ")[0], "last": last.partition(" ")[0], "lines": n, "blocks": len(directory)}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.string()), ("first", pa.string()), ("last", pa.string()), ("lines", pa.int64()), ("blocks", pa.int64())]))

    return run


def files_of(key: str, firsts: list[str], lasts: list[str]) -> range:
    """Which of the index files, in order, can hold the key: one, or as many as its captures fill."""
    begin = end = bisect_left(lasts, key)
    while end < len(firsts) and firsts[end] <= key:
        end += 1
    return range(begin, end)


class IndexFile:
    """One range of the index: its directory, and the last block that was read."""

    def __init__(self, place: fs.FileSystem, path: str) -> None:
        with place.open_input_file(f"{path}.directory") as f:
            rows = [r.split(" ") for r in f.read().decode().split("\n")]
        self.keys, self.places = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.data, self.now = place.open_input_file(path), -1
        self.reads = 0

    def block(self, k: int) -> list[tuple[str, str]]:
        if k != self.now:
            offset, length = self.places[k]
            lines = gzip.decompress(self.data.read_at(length, offset)).decode().split("\n")
            self.now, self.held = k, [(x.partition(" ")[0], x) for x in lines]
            self.reads += 1
        return self.held

    def find(self, key: str) -> Iterator[str]:
        """The lines of a key, by binary search in the directory, then in the block; a key can begin in the block before the first that begins with it."""
        for k in range(max(0, bisect_left(self.keys, key) - 1), len(self.keys)):
            if self.keys[k] > key:
                return
            held = self.block(k)
            for at in range(bisect_left(held, (key, "")), len(held)):
                if held[at][0] != key:
                    return
                yield held[at][1]

    def close(self) -> None:
        self.data.close()


def parsed(data: bytes) -> tuple[dict[str, str], int, str, bytes]:
    """Headers, payload's length, its digest and the payload itself (empty for revisits) of one member."""
    head, _, rest = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "revisit":
        return headers, int(re.search(rb"Content-Length: (\d+)", http)[1]), said, b""
    if (digest := digest_of(payload)) != said:
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}: the payload's digest is {digest}, not {said}")
    return headers, len(payload), digest, payload


def stretches(places: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of (offset, length) that follow each other without a gap, of up to READ bytes."""
    run: list[tuple[int, int]] = []
    for offset, length in places:
        if run and (offset != sum(run[-1]) or offset + length - run[0][0] > READ):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


@dataclass(frozen=True)
class Archive:
    """Archives and their index in a folder; ``files`` are the index's ranges in order, at most one for each partition that wrote it."""

    spark: SparkSession
    folder: str
    files: tuple[dict, ...]

    def find(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """(line, file, offset, length) of every capture of the urls' keys, each once however often a url is asked for."""
        folder, names, firsts, lasts = self.folder, [f["file"] for f in self.files], [f["first"] for f in self.files], [f["last"] for f in self.files]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(k, key) for key in {surt(u) for u in batch.column(0).to_pylist()} for k in files_of(key, firsts, lasts)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([key for _, key in found], pa.string())], names=["range", "key"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, root = store(folder)
            open_at, index = -1, None
            for batch in batches:
                lines = []
                for k, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if k != open_at:
                        if index is not None:
                            index.close()
                        open_at, index = k, IndexFile(place, f"{root}/{names[k]}")
                    lines += index.find(key)
                at = [json.loads(x.split(" ", 2)[2]) for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([x["filename"] for x in at], pa.string()), pa.array([x["offset"] for x in at], pa.int64()), pa.array([x["length"] for x in at], pa.int64())], names=["line", "file", "offset", "length"])
            if index is not None:
                index.close()

        asked = urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(route, "range int, key string").distinct()
        return asked.repartition("range").sortWithinPartitions("range", "key").mapInArrow(search, f"line string, {PLACE}")

    def read(self, places: DataFrame, payload: bool = True) -> DataFrame:
        """The records at (file, offset, length), read in stretches; ``payload`` adds the payloads themselves."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, root = store(folder)
            for batch in batches:
                rows = zip(*(batch.column(k).to_pylist() for k in range(3)))
                for name, of in groupby(rows, key=lambda r: r[0]):
                    with place.open_input_file(f"{root}/{name}") as data:
                        for run in stretches([(o, n) for _, o, n in of]):
                            begin = run[0][0]
                            held = data.read_at(sum(run[-1]) - begin, begin)
                            found = [parsed(held[o - begin : o - begin + n]) for o, n in run]
                            columns = [
                                [page_of(h["WARC-Record-ID"]) for h, *_ in found],
                                [h["WARC-Target-URI"] for h, *_ in found],
                                [h["WARC-Date"] for h, *_ in found],
                                [h["WARC-Type"] for h, *_ in found],
                                [page_of(h.get("WARC-Refers-To")) for h, *_ in found],
                            ]
                            arrays = [*(pa.array(c, pa.string()) for c in columns), pa.array([n for _, n, _, _ in found], pa.int64()), pa.array([d for _, _, d, _ in found], pa.string())]
                            names_of = ["id", "url", "date", "record_type", "refers_to", "payload_bytes", "payload_digest"]
                            if payload:
                                arrays, names_of = [*arrays, pa.array([p for *_, p in found], pa.binary())], [*names_of, "payload"]
                            yield pa.RecordBatch.from_arrays(arrays, names=names_of)

        stretch = F.floor(F.col("offset") / STRETCH)
        # a number of parts of our own: rows are small, what they stand for isn't, so they mustn't be put together by size
        dealt = places.select("file", "offset", "length").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "file", stretch).sortWithinPartitions("file", "offset")
        return dealt.mapInArrow(run, RECORD + ", payload binary" * payload)


def write(pages: DataFrame, folder: str, least: int = 0, date: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, block: int = BLOCK) -> Archive:
    """Writes the pages' archives and index in a new folder. ``date`` (of the captures, as in 2024-01-31T00:00:00Z) is now unless given."""
    spark = pages.sparkSession
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    place, root = store(folder)
    place.create_dir(root, recursive=True)
    # written as a table: the lines name the attempts' files that count
    lines = written(grouped(pages, id_col, url_col, html_col, least).mapInArrow(archiver(folder, date, archive_bytes), CAPTURE).select("line"), "captures")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = lines.repartitionByRange(parts, "line").sortWithinPartitions("line").mapInArrow(indexer(folder, block), "file string, first string, last string, lines long, blocks long")
    # one row for each partition
    files = sorted((r.asDict() for r in ranges.collect()), key=lambda r: (r["last"], r["first"]))
    with place.open_output_stream(f"{root}/manifest.json", compression=None) as out:
        out.write(json.dumps(files).encode())
    return Archive(spark, folder, tuple(files))


def open_archive(spark: SparkSession, folder: str) -> Archive:
    """An archive that was written before."""
    place, root = store(folder)
    with place.open_input_file(f"{root}/manifest.json") as f:
        return Archive(spark, folder, tuple(json.loads(f.read())))
