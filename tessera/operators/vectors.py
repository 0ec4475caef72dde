"""Nearest vectors by an inverted file of cells: centroids, a table of vectors by cell, searches of the nearest cells alone.

Equal vectors are one class, kept with its least ids, so a vector that a third of
all rows have is searched once. Centroids are fitted by spherical k-means on a
sample: the ``sample`` classes (20,000 unless set otherwise) whose ids have the
least hashes, drawn from all rows by a distributed top-k, so every row can be in
it. Every class is then given to its nearest centroid, whether sampled or not.
Cells of more than ``PART`` classes are dealt to parts, and the queries that probe
a cell are dealt to parts too; each pair of parts is one group, multiplied as
matrices, so no task holds a cell. The number of cells is the square root of the
number of classes, at most ``MOST_CELLS``: centroids are all that is sent to tasks.

A search is approximate: it sees the ``probes`` cells nearest to the query. Within
them likeness is exact (inner product in double precision; vectors are taken to be
of unit length, as cells are told by direction alone). How many cells that must be
depends on the vectors, so ``probes_for`` measures it: the nearest vectors of a
bounded sample are found by brute force in one pass over all, and the number is
such that the cells of the wanted share of them are among those probed.

Cases: null vectors and vectors without an id aren't indexed, and as queries find
nothing. Ties go to the lesser id. A query finds copies of itself but not its own
id. Zero vectors have likeness 0 with all. Vectors of different lengths are
refused. An empty table makes an index that finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written

SAMPLE, MOST_CELLS, PART, ROUNDS = 20_000, 16_384, 4_096, 12
#: Queries that the number of probes is measured on, and the share of their nearest that must be met.
MEASURED, RECALL = 1024, 0.98
#: Vectors of a block of the exact search, and queries that are multiplied with it at once.
BLOCK, STRIP = 16_384, 512


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * width:
        raise ValueError(f"vectors must all be {width} long")
    return flat.reshape(len(column), width)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def centroids(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means: directions that the sample gathers around. A cell that is left empty takes the vector that its own centroid fits worst."""
    x, at = unit(sample), np.random.default_rng(seed)
    found = x[at.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        likeness = x @ found.T
        own = likeness.argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(found)) == 0)
        sums[empty] = x[np.argsort(likeness.max(axis=1))[: len(empty)]]
        found = unit(sums)
    return found


def nearest_cells(batch: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each row, nearest first."""
    likeness = unit(batch) @ found.T
    few = np.argpartition(-likeness, min(n, found.shape[0]) - 1, axis=1)[:, :n]
    return np.take_along_axis(few, np.argsort(-np.take_along_axis(likeness, few, axis=1), axis=1, kind="stable"), axis=1)


@dataclass(frozen=True)
class Index:
    """Centroids, and a written table (cell, part, ids, vector) of classes; ``parts`` says how many parts a cell has."""

    found: np.ndarray
    table: DataFrame
    parts: DataFrame
    kept: int

    def placed(self, vectors: DataFrame, probes: int) -> DataFrame:
        """(key, vector, cell) of (key, vector), a row for each of the nearest cells."""
        found, width = self.found, self.found.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = nearest_cells(matrix(batch.column(1), width), found, min(probes, len(found)))
                    of = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(near.ravel().astype(np.int32))], names=["key", "vector", "cell"])

        return vectors.mapInArrow(run, f"key {vectors.schema['key'].dataType.simpleString()}, vector array<float>, cell int")

    def probes_for(self, recall: float = RECALL, measured: int = MEASURED) -> int:
        """The least number of cells to probe for which the share ``recall`` of up to ``measured`` classes would find their nearest other class."""
        rows = self.table.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(measured).select("ids", "vector").toArrow()
        found, width = self.found, self.found.shape[1] if len(self.found) else 0
        if rows.num_rows < 2:
            return max(1, len(found))
        own, asked = [r[0] for r in rows.column("ids").to_pylist()], matrix(rows.column("vector").combine_chunks(), width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, cells = np.full(len(own), -np.inf), np.zeros(len(own), np.int32)
            place = {i: k for k, i in enumerate(own)}
            for batch in batches:
                if batch.num_rows:
                    scores = asked @ matrix(batch.column(2), width).T
                    for c, ids in enumerate(batch.column(1).to_pylist()):
                        if ids[0] in place:
                            scores[place[ids[0]], c] = -np.inf
                    at = scores.argmax(axis=1)
                    best, cell = scores[np.arange(len(own)), at], batch.column(0).to_numpy()[at]
                    better = best > top
                    top, cells = np.where(better, best, top), np.where(better, cell, cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own)), pa.int32()), pa.array(top), pa.array(cells, pa.int32())], names=["q", "score", "cell"])

        # a row for each measured query and task, then one for each
        nearest = self.table.select("cell", "ids", "vector").mapInArrow(run, "q int, score double, cell int").groupBy("q").agg(F.max_by("cell", F.struct("score", "cell")).alias("cell")).collect()
        order = nearest_cells(asked, found, len(found))
        ranks = sorted(int(np.flatnonzero(order[r.q] == r.cell)[0]) + 1 for r in nearest)
        return ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)]

    def search(self, queries: DataFrame, id_col: str, vector_col: str, k: int = 1, probes: int | None = None) -> DataFrame:
        """(q, nearest, likeness, rank): each query's k nearest other vectors in the cells that it probes, as many as ``probes_for`` finds right unless given."""
        if not 1 <= k < self.kept:
            raise ValueError(f"the index holds {self.kept} ids of equal vectors, enough for {self.kept - 1} neighbours")
        asked = queries.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(vector_col).cast("array<float>").alias("vector"))
        if not len(self.found):
            kind = asked.schema["key"].dataType.simpleString()
            return asked.sparkSession.createDataFrame([], f"q {kind}, nearest {kind}, likeness double, rank int")
        width, kind = self.found.shape[1], asked.schema["key"].dataType.simpleString()
        probing = self.placed(asked, probes or self.probes_for())
        # as many parts of queries as keep a group to PART of them
        per_cell = probing.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / PART).cast("int").alias("q_parts"))
        sizes = written(self.parts.join(per_cell, "cell"), "grid")  # at most MOST_CELLS rows
        sides = F.broadcast(sizes)
        left = self.table.join(sides, "cell").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).select("cell", "part", "q_part", "ids", "vector")
        right = probing.join(sides, "cell").withColumn("q_part", F.pmod(F.xxhash64("key"), F.col("q_parts")).cast("int"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "q_part", "key", "vector")

        def best(classes: pa.Table, asking: pa.Table) -> pa.Table:
            q, near, likeness = [], [], []
            if classes.num_rows and asking.num_rows:
                known = matrix(classes.column("vector").combine_chunks(), width)
                ids, keys = classes.column("ids").to_pylist(), asking.column("key").to_pylist()
                scores = matrix(asking.column("vector").combine_chunks(), width) @ known.T
                # a query's own class can be among them, so one class more than asked for; ties at the edge are all looked at
                edge = -np.partition(-scores, min(k, len(ids) - 1), axis=1)[:, min(k, len(ids) - 1)]
                for row, key, least in zip(scores, keys, edge):
                    there = sorted((-row[c], i) for c in np.flatnonzero(row >= least) for i in ids[c] if i != key)[:k]
                    q += [key] * len(there)
                    near += [i for _, i in there]
                    likeness += [-s for s, _ in there]
            return pa.table({"q": pa.array(q, asking.schema.field("key").type), "nearest": pa.array(near, asking.schema.field("key").type), "likeness": pa.array(likeness, pa.float64())})

        on = ("cell", "part", "q_part")
        found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(best, f"q {kind}, nearest {kind}, likeness double")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("likeness"), "nearest"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def build(vectors: DataFrame, id_col: str, vector_col: str, cells: int | None = None, sample: int = SAMPLE, k: int = 1) -> Index:
    """The index of all vectors, for searches of up to k neighbours."""
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    classes = written(of_classes(rows, k + 1), "classes")
    n = classes.count()
    if not n:
        return Index(np.zeros((0, 0)), classes, classes, k + 1)
    chosen = classes.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample).select("vector").toArrow().column("vector").combine_chunks()
    width = len(chosen[0])
    found = centroids(matrix(chosen, width), min(cells or max(1, round(n**0.5)), MOST_CELLS))
    index = Index(found, classes, classes, k + 1)
    table = written(index.placed(classes.select(F.struct("ids").alias("key"), "vector"), 1).select("cell", F.col("key.ids").alias("ids"), "vector"), "cells")
    parts = written(table.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "parts")
    dealt = table.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("parts")).cast("int"))
    return Index(found, dealt.select("cell", "part", "ids", "vector"), parts, k + 1)


def of_classes(rows: DataFrame, kept: int) -> DataFrame:
    """(ids, vector) of distinct vectors, with the least ids that have each. Counted down within parts of a vector's rows first, so that no list is longer than ``kept`` for each part."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, kept)
    in_parts = Window.partitionBy("vector", "part").orderBy("id")
    few = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", F.row_number().over(in_parts)).filter(F.col("rank") <= kept)
    return few.groupBy("vector").agg(F.collect_list("id").alias("ids")).select(least(F.col("ids")).alias("ids"), "vector")


def nearest_of_all(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(q, nearest, likeness): each query's nearest other vector of all, by inner product; of equal ones the least id.

    All pairs are looked at: blocks of distinct vectors meet blocks of queries, each
    pair of blocks in a group of its own, multiplied as matrices in strips. What
    lies within a product's rounding of a query's best is added up again term by
    term, so likenesses and their ties don't depend on how the blocks fall.
    """
    known = lambda df: df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    classes = written(of_classes(known(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")), 2), "classes")
    asked = known(queries).select(F.col(id_col).cast("long").alias("key"), F.col(vector_col).cast("array<float>").alias("vector"))
    blocks = lambda n: max(1, -(-n // BLOCK))
    many, few = blocks(classes.count()), blocks(asked.count())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = classes.select(place(F.col("ids")[0], many).alias("i"), every(few).alias("j"), "ids", "vector")
    right = asked.select(every(many).alias("i"), place("key", few).alias("j"), "key", "vector")

    def best(classes: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if classes.num_rows and asking.num_rows:
            ids = classes.column("ids").to_pylist()
            width = len(classes.column("vector")[0])
            x, keys = matrix(classes.column("vector").combine_chunks(), width), asking.column("key").to_numpy()
            y = matrix(asking.column("vector").combine_chunks(), width)
            first, second = np.array([i[0] for i in ids]), np.array([i[-1] for i in ids])
            alone = {i[0]: c for c, i in enumerate(ids) if len(i) == 1}
            # twice what both ways of adding up can be off
            off = 4 * width * np.finfo(float).eps * np.linalg.norm(x, axis=1).max()
            for at in range(0, len(y), STRIP):
                one, of = y[at : at + STRIP], keys[at : at + STRIP]
                scores = one @ x.T
                own = [(r, alone[k]) for r, k in enumerate(of.tolist()) if k in alone]
                if own:
                    scores[tuple(np.array(own).T)] = -np.inf
                edge = scores.max(axis=1) - off * np.linalg.norm(one, axis=1)
                r, c = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
                exact = np.zeros(len(r))
                for k in range(width):
                    exact += x[c, k] * one[r, k]
                near = np.where(first[c] == of[r], second[c], first[c])
                order = np.lexsort((near, -exact, r))
                chosen = order[np.unique(r[order], return_index=True)[1]]
                found.append((of[r[chosen]], near[chosen], exact[chosen]))
        return pa.table(dict(zip(("q", "nearest", "likeness"), map(np.concatenate, zip(*found)))))

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "q long, nearest long, likeness double")
    return met.groupBy("q").agg(F.max(F.struct("likeness", (-F.col("nearest")).alias("low"))).alias("top")).select("q", (-F.col("top.low")).alias("nearest"), F.col("top.likeness").alias("likeness"))
