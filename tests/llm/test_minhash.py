"""Near duplicates against brute force over full sets of shingles."""

import os
import random
import re

import numpy as np
import pytest

from tessera.llm import minhash
from tessera.llm.queries import op5_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """{id: (size, component, kept)} from all pairs that share a shingle."""
    sets = {i: brute_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lists, seen = {}, {}
    for i in sorted(sets):
        seen.setdefault(frozenset(sets[i]), []).append(i)
    for same, ids in seen.items():
        if same:
            for i in ids[1:]:
                parent[root(i)] = root(ids[0])
    for same, ids in seen.items():
        for x in same:
            lists.setdefault(x, []).append(ids[0])
    shared = {}
    for ids in lists.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def plain(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert plain(op5_minhash(spark, folder)) == brute(docs)


@pytest.mark.parametrize(("common", "block", "size"), [(3, 8, 300), (50, 512, 60)])
def test_chains_and_groups(spark, monkeypatch, common, block, size):
    """Chains of small edits, passages that many texts share and a large group of near copies, with long lists and without, in small blocks and large, of sets that wide sketches hold and that they don't."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=60)
    docs = []
    for _ in range(12):
        text = rng.choices(words, k=rng.randint(20, size))
        for _ in range(rng.randint(1, 6)):
            docs.append(" ".join(text))
            text = [*text]
            text[rng.randrange(len(text))] = rng.choice(words)
    docs += [" ".join([*rng.choices(words, k=n), *passage]) for n in (2, 4, 5, 6, 8, 9, 10, 12, 14, 30) for _ in range(4)]
    group = rng.choices(words, k=size + 20)
    docs += [" ".join([*group[:k], "x", *group[k + 1 :]]) for k in range(0, size + 20, 2)]
    # texts of one passage and an end of their own: in the same long lists, most pairs not near
    shared = rng.choices(words, k=size)
    docs += [" ".join([*shared, *(f"own{k}_{j}" for j in range(size // 5 + k % 7))]) for k in range(60)]
    rng.shuffle(docs)
    rows = [*enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(minhash.near_duplicates(df, common)) == brute(rows)


@pytest.mark.parametrize("size", [146, 700])
def test_few_texts_of_a_large_group_are_compared_with_all(spark, monkeypatch, size):
    """Copies of one text with few edits and many, of sets that wide sketches hold and that they don't: where they do, a leader links all but a few of those that can be near by what is common."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=size + 4)
    docs = []
    for k in range(400):
        text = [*base]
        for at in rng.sample(range(size), k * size // 4000):
            text[at] = rng.choice(words)
        docs.append(" ".join(text))
    rng.shuffle(docs)
    left = []
    largest = minhash.largest

    def counted(entries):
        tops = largest(entries)
        left.extend((r.texts, r.texts - r.top["count"]) for r in tops.collect())
        return tops

    monkeypatch.setattr(minhash, "largest", counted)
    rows = [*enumerate(docs)]
    assert plain(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    share = sum(n for _, n in left) / max(1, sum(n for n, _ in left))
    print("entries of lists", sum(n for n, _ in left), "outside the largest component", share)
    assert size > minhash.WIDE or share < 0.1


def test_counts_of_shared_values(monkeypatch):
    rng = np.random.default_rng(3)
    xs, ys = ([np.unique(rng.integers(0, 300, n)) for n in sizes] for sizes in ((1, 40, 200), (5, 90, 1, 250)))
    for columns in (7, 4096):
        monkeypatch.setattr(minhash, "COLUMNS", columns)
        assert minhash.shared_counts(xs, ys).tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    assert minhash.shared_counts([np.array([1, 2])], [np.array([3])]).tolist() == [[0]]


def test_nulls_ties_and_small_tables(spark):
    rows = [(5, None), (4, ""), (3, " \n\t "), (2, "A b"), (1, "a B"), (9, "a b c d e f"), (8, "A  b c\nd e f"), (7, "a b c d e"), (6, "word " * 30_000), (10, "word " * 5), (None, "zeta eta theta"), (12, "zeta eta theta")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS v", "3 AS n", "4 AS component")
    got = plain(minhash.near_duplicates(df))
    assert got == {
        5: (0, 5, True), 4: (0, 4, True), 3: (0, 3, True), 2: (1, 1, False), 1: (1, 1, True), 9: (2, 8, False), 8: (2, 8, True), 7: (1, 7, True),
        6: (1, 6, True), 10: (1, 6, False), None: (1, None, True), 12: (1, None, False),
    }
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    twice = minhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (1, "x y z"), (2, "x y z"), (3, "a b c")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in twice.collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_ids_of_any_type_and_repeated_ones(spark):
    rows = [("b", "one two three four five six seven"), ("a", "One two three four five six seven"), ("a", "quite other words than those"), (None, "quite other words than those"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [("None", "None", True), ("a", "None", False), ("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_one_of_each_group_stays(spark):
    rows = [(7, "a b c d", "s"), (7, "a b c d", "s"), (7, "unlike all others", "s"), (3, "a B c d", "t"), (None, "x y", "u"), (None, "x y", "u"), (9, None, "v"), (9, None, "v"), (None, "", "w"), (10, "X  Y", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_of string").selectExpr("*", "1 AS row", "2 AS t", "3 AS id")
    out = minhash.one_of_each(df)
    assert out.columns == df.columns
    want = [(3, "a B c d", "t", 1), (7, "unlike all others", "s", 1), (None, "x y", "u", 1), (9, None, "v", 1), (9, None, "v", 1), (None, "", "w", 1)]
    assert sorted(((r.doc_id, r.text, r.near_of, r.row) for r in out.collect()), key=str) == sorted(want, key=str)
    assert minhash.one_of_each(df.limit(0)).count() == 0


@pytest.mark.skipif("SLOW_TESTS" not in os.environ, reason="takes minutes")
def test_recall_on_the_larger_table(spark):
    """Every link of 10,000 documents against brute force over full sets."""
    folder = "/root/testdata/sf0.1"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got, want = plain(op5_minhash(spark, folder)), brute(docs)
    linked = [i for i, (_, c, _) in want.items() if c != i]
    print("recall of linked documents", sum(got[i] == want[i] for i in linked) / len(linked), "of", len(linked))
    assert got == want
