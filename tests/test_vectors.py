"""The vector index against all pairs: recall on the given tables, exactness when all cells are probed, copies, hot cells."""

import numpy as np
import pytest

from tessera.operators import vectors
from tessera.plans import catalogue


def made(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids if ids is not None else range(len(x)), x)], "id long, v array<float>")


def exact(x, q, k=1):
    x = x.astype(np.float32).astype(np.float64)
    out = {}
    for i in q:
        s = x @ x[i]
        out[i] = [j for _, j in sorted((-s[j], j) for j in range(len(x)) if j != i)[:k]]
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_given_vectors(spark, folder):
    best = {r.q: r.likeness for r in catalogue.QUERIES["vector_top1"](spark, folder).collect()}
    found = {r.q: r.likeness for r in catalogue.QUERIES["vector_index_top1"](spark, folder).collect()}
    assert found.keys() == best.keys()
    recall = np.mean([found[q] >= best[q] for q in best])
    assert recall >= 0.9


def test_all_cells_and_parts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 7)
    x = np.random.default_rng(1).normal(size=(120, 8))
    x[100:] = x[0]
    df = made(spark, x)
    found = vectors.build(df, "id", "v", cells=5, k=3).search(df.filter("id % 5 = 0"), "id", "v", k=3, probes=5)
    got = {}
    for r in found.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.nearest)
    assert got == exact(x, range(0, 120, 5), 3)


def test_copies_are_one_class(spark):
    """A third of the rows has one vector: the index holds it once, and each copy finds the least other one."""
    x = np.random.default_rng(2).normal(size=(90, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0]
    df = made(spark, x)
    index = vectors.build(df, "id", "v")
    assert index.table.count() == 61
    got = {r.q: r.nearest for r in index.search(df.filter("id % 3 = 0"), "id", "v", probes=100).collect()}
    assert got == {i: (3 if i == 0 else 0) for i in range(0, 90, 3)}


def test_nulls_zeros_empties_and_lengths(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0])], "id long, v array<float>")
    index = vectors.build(df, "id", "v")
    assert {r.q: (r.nearest, r.likeness) for r in index.search(df, "id", "v", probes=9).collect()} == {1: (3, 0.0), 3: (4, 1.0), 4: (3, 1.0)}
    assert vectors.build(df.limit(0), "id", "v").search(df, "id", "v").count() == 0
    with pytest.raises(ValueError, match="enough for 1"):
        index.search(df, "id", "v", k=2)


def test_probes_are_measured(spark):
    """Of tight clusters one cell is enough; of vectors in all directions, more."""
    at = np.random.default_rng(3)
    centres = at.normal(size=(8, 16)) * 10
    tight = centres[np.arange(160) % 8] + at.normal(size=(160, 16)) * 0.05
    loose = at.normal(size=(160, 16))
    probes = [vectors.build(made(spark, x / np.linalg.norm(x, axis=1, keepdims=True)), "id", "v", cells=8).probes_for(0.9) for x in (tight, loose)]
    assert probes[0] == 1 < probes[1] <= 8
