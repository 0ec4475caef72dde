"""Audit of how filters interact: what each removes in every order in which they could be applied.

A document's failed filters make a mask. One pass sets the masks, with built-in
functions on the whole text; copies are told by the least id of each text's
SHA-256. Counts by part and mask (all documents, good ones, toxic ones) are the
only thing that the rest reads: they are stacked as rows of an incidence matrix
and multiplied by four integer matrices of 2^k rows and k * k! columns, which say
for each mask, order of the k filters and step whether such a document is kept,
removed, redundant (failing, but removed earlier) or fails that filter alone. The
parts are dealt out, so no task and no driver holds more than a few parts' rows.

Cases: a null or empty text has no words, no capitals and no signs. A null source
and an empty one are the same part. A document is a copy if its id is larger than
the least id with its text; rows of one id and text aren't copies of each other,
and rows without an id are no copies and make none. A document with several
labels is good or toxic if any of them says so; labels without an id or of other
documents count nowhere. Texts are worked on whole. Only the columns named are
read, whatever further ones are called. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, words, written
from tessera.llm.quality_rules import let, without

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
#: Parts that are multiplied at once.
PARTS = 64


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every document: bit k is set if it fails the k-th of A, B, C, D (by text) and E (a copy of a lesser id's)."""
    text = text_or_empty(text_col)
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    of_words = let(counted, lambda c: (c["n"] < 50).cast("int") + 2 * (100 * c["distinct"] < 65 * c["n"]).cast("int"))
    of_signs = 4 * (100 * without(text, "[^A-Z]+") > 5 * F.length(text).cast("long")).cast("int") + 8 * text.rlike(r"[#$%&*|]").cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), (of_words + of_signs).alias("mask"))
    # narrow rows, read three times; texts are read once
    rows = written(rows, "masks")
    known = rows.filter("doc_id IS NOT NULL")
    # no hot key: the copies of a text meet as partial minima, and the join is on text and id
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copies = known.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"))
    return copies.unionByName(rows.filter("doc_id IS NULL").select("doc_id", "part", "mask"))


def histograms(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(is_one(good_col).alias("good"), is_one(toxic_col).alias("toxic"))
    known = known.filter("good + toxic > 0")
    labelled = found.join(known, "doc_id").select("part", "mask", F.lit(0).alias("n"), "good", "toxic")
    every = found.select("part", "mask", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return every.unionByName(labelled).groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))


def outcomes(filters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The columns (order, step) and, by name, the matrices of masks by columns."""
    columns = [("".join(order), step) for order in permutations(filters) for step in range(1, len(filters) + 1)]
    made = {name: np.zeros((1 << len(filters), len(columns)), np.int64) for name in ("kept", "removed", "redundant", "unique")}
    for c, (order, step) in enumerate(columns):
        own, before = 1 << filters.index(order[step - 1]), sum(1 << filters.index(x) for x in order[: step - 1])
        for mask in range(1 << len(filters)):
            made["kept"][mask, c] = not mask & (own | before)
            made["removed"][mask, c] = bool(mask & own) and not mask & before
            made["redundant"][mask, c] = bool(mask & own) and bool(mask & before)
            made["unique"][mask, c] = mask == own
    return columns, made


def audit(counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """The outcome of each part, order and step, from ``histograms``. There are at most 2^k rows for a part, which one row gathers."""
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, by = outcomes(filters)
        orders, steps = pa.array([o for o, _ in columns]), pa.array([s for _, s in columns], pa.int32())
        own = np.array([filters.index(o[s - 1]) for o, s in columns])
        same = (own[:, None] == own[None, :]).astype(np.int64)  # columns of one filter
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                piece = batch.slice(at, PARTS)
                stacked = np.zeros((3, piece.num_rows, 1 << len(filters)), np.int64)
                for k, found in enumerate(piece.column(1).to_pylist()):
                    for r in found:
                        stacked[:, k, r["mask"]] = r["n"], r["good"], r["toxic"]
                every, good, toxic = stacked
                removed = every @ by["removed"]
                values = (every @ by["kept"], removed, every @ by["redundant"], every @ by["unique"], good @ by["removed"], toxic @ by["removed"], removed @ same)
                n = piece.num_rows
                part = piece.column(0).take(pa.array(np.repeat(np.arange(n), len(columns))))
                yield pa.RecordBatch.from_arrays([part, pa.concat_arrays([orders] * n), pa.concat_arrays([steps] * n), *(pa.array(v.ravel()) for v in values)], names=["part", "filter_order", "step", *COUNTS])

    return rows.mapInArrow(multiplied, OUT)
