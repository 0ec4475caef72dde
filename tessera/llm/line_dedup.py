"""Removal of repeated lines: hashes dealt by range, streamed in order, and bitmaps instead of texts.

Each line's key is hashed to 128 bits. (hash, document, position) rows are
range-partitioned and sorted by all of these, so the rows of one hash follow
each other, and a hash that half the corpus shares is spread over as many
partitions as its rows fill. One pass over each partition reports the number of
documents of its first and last hash, the only ones that other partitions can
hold too; with these sums, a second pass streams the runs and marks the lines to
drop: all lines of keys in at least ``min_docs`` documents, or, with
``keep_first``, all but the first occurrence. What goes back to the documents is
a compressed bitmap of kept lines, never text.

Cases: a null or empty text is one empty line. A key of no code points is never
dropped. Equal lines of one document count as one document. Rows that repeat a
document id count as one document, and so do rows whose id is null or, as that
stands for it, the least 64-bit number; each row loses the lines of its own text
alone, as rows are told apart by a 64-bit hash of the text beside the id. Rows
equal in both lose the same lines. With ``keep_first`` an occurrence is the first
by id, then row, then position. Ids are whole numbers or text. Very long texts
are split whole, one at a time. Only the id and text columns are read; of clashing
names, the columns n_lines and n_dropped are replaced, all others stay. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tessera.llm.common import SPACES, checkpointed, text_or_empty, unused, written

#: Stand for a null id: rows carry no nulls to the passes over partitions.
NO_ID, NO_NAME = -(1 << 63), "\0"
ROWS = 256
RUN = "h1 long, h2 long, docs long, part int, last boolean"


def document_key(docs: DataFrame, id_col: str) -> Column:
    """A document's id, which is never null."""
    return F.coalesce(F.col(id_col), F.lit(NO_NAME if isinstance(docs.schema[id_col].dataType, StringType) else NO_ID))


def row_key(text_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(text_or_empty(text_col))


def line_hash(line: bytes) -> bytes | None:
    """128 bits of a line's key: without spaces at its ends, A-Z in lower case (bytes know no other capitals); none for a key of no code points."""
    key = line.strip(SPACES.encode()).lower()
    return xxhash.xxh3_128_digest(key) if key else None


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc, pos, row) of the lines of (doc, row, text)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            digests, places, counts = [], [], []
            for text in rows.column(2).cast(pa.binary()).to_pylist():
                found = [(k, h) for k, line in enumerate((text or b"").split(b"\n")) if (h := line_hash(line)) is not None]
                counts.append(len(found))
                places += [k for k, _ in found]
                digests += [h for _, h in found]
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            of = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), rows.column(0).take(of), pa.array(places, pa.int32()), rows.column(1).take(of)], names=["h1", "h2", "doc", "pos", "row"])


def hashed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, doc, pos, row) of each line with a key."""
    rows = docs.select(document_key(docs, id_col).alias("doc"), row_key(text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(hashed, f"h1 long, h2 long, doc {rows.schema['doc'].dataType.simpleString()}, pos int, row long")


def runs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Where a new hash begins."""
    return np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.array([], int)


def column(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False)


def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: the documents of its first hash and of its last."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first = last = None  # [h1, h2, documents]
    doc_before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (column(batch, k) for k in range(3))
        starts = runs(h1, h2)
        new_doc = np.r_[True, (doc[1:] != doc[:-1])]
        new_doc[starts] = True
        if last is not None and (h1[0], h2[0]) == tuple(last[:2]):
            new_doc[0] = doc[0] != doc_before
        counts = np.add.reduceat(new_doc.astype(np.int64), starts)
        for k in dict.fromkeys((0, len(starts) - 1)):
            key = (h1[starts[k]], h2[starts[k]])
            if last is not None and tuple(last[:2]) == key:
                last[2] += counts[k]
            else:
                last = [*key, counts[k]]
            if first is None:
                first = last
        doc_before = doc[-1]
    found = [] if first is None else [[*first, part, False], [*last, part, True]] if last is not first else [[*first, part, False]]
    yield pa.RecordBatch.from_pylist([dict(zip(("h1", "h2", "docs", "part", "last"), map(lambda x: x.item() if isinstance(x, np.generic) else x, r))) for r in found], schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64()), ("part", pa.int32()), ("last", pa.bool_())]))


def marker(shared: dict, begun: set, min_docs: int, keep_first: bool):
    """The second pass. shared: documents of each hash that lies at partitions' edges; begun: (partition, hash) whose first occurrence lies before the partition."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []  # doc, pos, row of the run that goes on, while it has too few documents to be dropped
        key, seen, doc_before, dropping, first = None, 0, None, False, None

        def out(doc: np.ndarray, pos: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos, pa.int32()), pa.array(row, pa.int64())], names=["doc", "pos", "row"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, pos, row = (column(batch, k) for k in range(5))
            starts = runs(h1, h2)
            drops = []
            for a, b in zip(starts, [*starts[1:], len(h1)]):
                if (h1[a], h2[a]) != key:
                    key, seen, doc_before, held = (h1[a], h2[a]), 0, None, []
                    dropping = shared.get((int(key[0]), int(key[1])), 0) >= min_docs
                    first = (doc[a : a + 1], pos[a : a + 1], row[a : a + 1]) if (part, int(key[0]), int(key[1])) not in begun else None
                d, p, r = doc[a:b], pos[a:b], row[a:b]
                if keep_first:
                    rows = np.c_[d, p, r]
                    # copies of the first row stay as it does, as they share its bitmap
                    drops.append(rows if first is None else rows[(d != first[0]) | (p != first[1]) | (r != first[2])])
                    continue
                seen += int((d[1:] != d[:-1]).sum()) + int(d[0] != doc_before)
                doc_before = d[-1]
                if not dropping and seen >= min_docs:
                    dropping = True
                    drops += held
                    held = []
                (drops if dropping else held).append(np.c_[d, p, r])
            if drops and len(both := np.concatenate(drops)):
                yield out(both[:, 0].astype(doc.dtype), both[:, 1], both[:, 2])

    return mark


@F.pandas_udf(BinaryType())
def packed(positions: pd.Series) -> pd.Series:
    """Bitmap of dropped lines (bit k for line k), compressed."""
    return positions.map(lambda x: pack(np.asarray(x)))


def pack(positions: np.ndarray) -> bytes:
    bits = np.zeros(int(positions.max()) + 1, np.uint8)
    bits[positions] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of n lines the bitmap drops."""
    found = np.zeros(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n]
        found[: len(bits)] = bits.astype(bool)
    return found


def bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dropped_row, dropped): for each document that loses lines, the compressed bitmap of these. The id is the document's key, dropped_row that of its text."""
    spark = docs.sparkSession
    # ranges are sampled from the hashes, not by splitting all texts once more
    lines = written(hashed_lines(docs, id_col, text_col), "hashes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(lines.repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "row", "pos"))
    # at most two rows for each partition, whatever the input
    found = dealt.mapInArrow(edges, RUN).collect()
    shared, begun = {}, set()
    for r in sorted(found, key=lambda r: (r.part, r["last"])):
        if (r.h1, r.h2) in shared:
            begun.add((r.part, r.h1, r.h2))
        shared[r.h1, r.h2] = shared.get((r.h1, r.h2), 0) + r.docs
    kind = dealt.schema["doc"].dataType.simpleString()
    drops = dealt.mapInArrow(marker(shared, begun, min_docs, keep_first), f"doc {kind}, pos int, row long")
    return drops.groupBy("doc", "row").agg(F.collect_set("pos").alias("pos")).select(F.col("doc").alias(id_col), F.col("row").alias("dropped_row"), packed("pos").alias("dropped"))


def apply(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with ``text_col`` as kept and further columns n_lines (before), n_dropped. Columns of these names are replaced."""
    docs = docs.drop("n_lines", "n_dropped")
    bits, doc, row = unused(docs.columns, "dropped", "dropped_of", "dropped_row")
    of = dropped.select(F.col(id_col).alias(doc), F.col("dropped_row").alias(row), F.col("dropped").alias(bits))
    joined = docs.join(of, (document_key(docs, id_col) == F.col(doc)) & (row_key(text_col) == F.col(row)), "left").drop(doc, row)
    names = docs.columns
    kinds = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names]
    at_text, at_bitmap = joined.columns.index(text_col), joined.columns.index(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, bitmap in zip(batch.column(at_text).to_pylist(), batch.column(at_bitmap).to_pylist()):
                lines = (text or "").split("\n")
                if bitmap is None:
                    texts.append(text)
                    gone = 0
                else:
                    drop = unpack(bitmap, len(lines))
                    gone = int(drop.sum())
                    texts.append("\n".join(x for x, d in zip(lines, drop) if not d))
                n_lines.append(len(lines))
                n_dropped.append(gone)
            of = dict(zip(joined_names, batch.columns)) | {text_col: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*(of[n] for n in names), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    joined_names = joined.columns
    return joined.mapInArrow(run, ", ".join([*kinds, "n_lines long", "n_dropped long"]))


def dedup(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that ``bitmaps`` drops."""
    return apply(docs, bitmaps(docs, min_docs, keep_first, id_col, text_col), id_col, text_col)
