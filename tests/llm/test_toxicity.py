"""The automaton against edit distance; scores on held-out labels."""

import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import toxicity
from tessera.llm.queries import op4_toxicity

ENTRIES = ["abacab", "abba", "cabbacabba", "bcabc*", "aab*", "ccccccccc", "é"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="abcé", max_size=12))
def test_automaton_matches_edit_distance(word):
    automaton = toxicity.Automaton(ENTRIES)
    near = []
    for k, e in enumerate(ENTRIES):
        if not e.endswith("*"):
            d, limit = distance(word, e), (len(e) >= toxicity.ONE_EDIT) + (len(e) >= toxicity.TWO_EDITS)
            if d <= limit:
                near.append((d, k))
    stems = [(0, k) for k, e in enumerate(ENTRIES) if e.endswith("*") and word.startswith(e[:-1])]
    got = automaton.match(word)
    if near and (min(near)[0] == 0 or not stems):
        assert got == min(near)
    elif stems:
        assert got in stems
    else:
        assert got is None


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1.0
    for v in np.unique(scores):
        order[scores == v] = order[scores == v].mean()
    n = labels.sum()
    return (order[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op4_toxicity(spark, folder).collect()}
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r.doc_id].held_out]
    y, s = np.array([r.toxic for r in held]), np.array([rows[r.doc_id].score for r in held])
    print("AUC", auc(s, y), "accuracy", ((s >= 0.5) == y).mean(), "recall", (s >= 0.5)[y == 1].mean())
    assert auc(s, y) > 0.95 and ((s >= 0.5) == y).mean() > 0.96


def train(spark, extra=()):
    rows = [(i, f"word{i} you are an idiot and a moron fool{'s' * (i % 3)} number" if i % 4 == 0 else f"word{i} you are a friend and a person of good will", int(i % 4 == 0)) for i in range(200)]
    rows += [(1000 + i, f'they said "you idiot" and left, text {i}', 0) for i in range(30)]
    df = spark.createDataFrame([*rows, *extra], "doc_id long, text string, toxic int")
    return toxicity.learn(df.drop("toxic"), df.select("doc_id", "toxic"))


def test_misspelling_and_quotation(spark):
    model = train(spark)
    abuse, misspelled = model.score("you are an idiot and a moron"), model.score("you are an idiiot and a morron")
    quote, clean = model.score('he wrote "you idiot" to them'), model.score("you are a friend")
    assert abuse > 0.5 > clean and misspelled > clean and quote < abuse and quote < 0.5


def test_quotations_are_paired():
    at = lambda t: toxicity.quoted(t, t.index("idiot"), t.index("idiot") + 5)
    assert at('she heard "you idiot" and left') and at("man rief „du idiot“ laut") and at("on entendit «quel idiot» hier")
    # between two quotations, after one, before one
    assert not at('"hi," and then. you idiot. "bye."') and not at('"hi." you idiot') and not at('you idiot. "bye."')
    assert at('he said "you idiot') and not at("don't be an idiot, isn't it") and not at("you idiot")
    assert at('"one" and "two idiot three" and "four"') and not at('"one" and idiot and "two"')


def plain_match(entries, exact, word):
    """The nearest entry by edit distance to every one."""
    near = []
    for k, e in enumerate(entries):
        if not e.endswith("*"):
            d = distance(word, e)
            if d <= (0 if k in exact else (len(e) >= toxicity.ONE_EDIT) + (len(e) >= toxicity.TWO_EDITS)):
                near.append((d, k))
    stems = [(len(e), k) for k, e in enumerate(entries) if e.endswith("*") and word.startswith(e[:-1])]
    best = min(near) if near else None
    return best if best and (best[0] == 0 or not stems) else (0, max(stems)[1]) if stems else None


def plain_score(model, text):
    """The score from edit distances to every entry and the sums of the model, without the automaton."""
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text.lower())]
    exact = {k for k, v in enumerate(model.missed) if not v}
    sums = {True: {}, False: {}}
    for word, start, end in words:
        if (hit := plain_match(model.entries, exact, word)) is not None:
            of = sums[toxicity.quoted(text.lower(), start, end)]
            of[hit[1], hit[0] > 0] = of.get((hit[1], hit[0] > 0), 0) + 1
    weighed = lambda of: math.log1p(sum((model.missed if e else model.weights)[k] * math.log1p(n) for (k, e), n in of.items()))
    abuse = sums[False]
    x = [weighed(abuse), weighed(sums[True]), float(bool(abuse)), sum(abuse.values()) / max(1, len(words)), math.log1p(len(words))]
    z = model.bias + sum(s * (v - m) / d for s, v, m, d in zip(model.slopes, x, model.mean, model.scale))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_match_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = toxicity.learn(docs, toxicity.learnable(spark.read.parquet(f"{folder}/labels.parquet")))
    assert model.entries
    rows = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in sorted(docs.collect(), key=lambda r: len(r.text))[:120]:
        assert abs(rows[r.doc_id] - plain_score(model, r.text)) < 1e-9
    made = train(spark)
    for text in ('you idiot, you "idiot" and morron', "fools and foolish moron's idiiot", "", "l'idiot"):
        assert abs(made.score(text) - plain_score(made, text)) < 1e-9


def test_nulls_and_tables_without_labels(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "x " * 100_000)], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS label")
    model = train(spark)
    got = sorted((r.doc_id, r.score) for r in toxicity.score(df, model).collect())
    assert [i for i, _ in got] == [1, 2, 2, 3] and all(s < 0.5 for _, s in got)
    none = toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.entries == [] and toxicity.score(df, none).first().score < 0.5
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.score(df, model, keep=True).columns == ["doc_id", "text", "score", "label", "tox_score"]


def one_edit(word):
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in "qz"} | {a + c + b[1:] for a, b in cuts if b for c in "qz"}


def test_learned_words_are_read_with_edits(spark):
    # 8 to 12 letters; each text has all of them, so that stems are as rare as the words, and stems with more texts than their words
    terms = ["pathetic", "worthless", "disgusting", "abominationx"]
    clean = ["worthy", "wortlaut", "pathway", "pathology", "discover", "abomasum"]
    rows = [(i, f"you are {' '.join(terms[:3])} word{i} gruesomely" if i % 2 else f"you {terms[3]} {'grueling' if i % 4 else 'gruesome'} word{i}", 1) for i in range(60)]
    rows += [(100 + i, f"you are a friend and a person of good will word{i}", 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.drop("toxic"), df.select("doc_id", "toxic"))
    match = model.automaton.match
    for term in [*terms, "gruesomely"]:
        assert term in model.entries
        once = one_edit(term)
        assert all(match(w) for w in once), term
        if len(term) >= toxicity.TWO_EDITS:
            assert all(match(w) for v in sorted(once)[::9] for w in one_edit(v)), term
    assert not [w for w in clean if match(w)]
    assert model.score("you are wqrthless") > 0.5 > model.score("a worthy pathway to discover")


@pytest.mark.parametrize("seed", range(6))
def test_choice_as_a_plain_greedy(seed):
    """Every round recounted from the texts; no number of entries is cut off."""
    at = random.Random(seed)
    words = [at.choice(["abcde", "abcdx", "bcdef", "cdefghij", "xyz"]) + at.choice(["", "q", "rst", "uvwxyz"]) + str(k % 7).translate(str.maketrans("0123456", "klmnopq")) for k in range(450)]
    keys = sorted({k for w in words for k in toxicity.keys_of(w)})
    texts = [sorted(j for w in at.sample(words, at.randrange(1, 9)) for j in {keys.index(k) for k in toxicity.keys_of(w)}) for _ in range(300)]
    texts = [sorted(set(t)) for t in texts]
    candidates = [(key, sum(k in t for t in texts), at.randrange(3)) for k, key in enumerate(keys)]
    odds = [math.log((t + 0.5) / 301) - math.log((o + 0.5) / 901) for _, t, o in candidates]
    related = toxicity.nested(keys)
    need, chosen = [toxicity.COVER] * len(texts), []
    while len(chosen) < len(keys):
        def still(j):
            return [i for i, t in enumerate(texts) if j in t and need[i] and not any(k in t for k in chosen if k in related[j])]

        there = {j: still(j) for j in range(len(keys)) if j not in chosen}
        k = max(there, key=lambda j: (sum(need[i] for i in there[j]) * odds[j], len(keys[j].rstrip("*")), not keys[j].endswith("*"), keys[j]))
        if len(there[k]) < 3:
            break
        for i in there[k]:
            need[i] -= 1
        chosen.append(k)
    entries, weights = toxicity.choose(candidates, texts, 300, 900)
    assert entries[: len(chosen)] == [keys[k] for k in chosen] and len(entries) == len(set(entries)) == len(weights)
    assert {k for k in keys if not k.endswith("*")} <= set(entries)


def test_entries_have_no_limit():
    words = [f"w{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}" for k in range(900)]
    entries, _ = toxicity.choose([(w, 3, 0) for w in words], [[k] for k in range(900)] * 3, 2700, 2700)
    assert sorted(entries) == sorted(words)


def test_a_worker_keeps_one_models_states():
    model = toxicity.Model(["idiot"], [1.0], [1.0])
    one, two = (pickle.loads(pickle.dumps(model)) for _ in range(2))
    assert one is two and one.found("you idiott") == {0}
    one.automaton.sets += [frozenset()] * toxicity.STATES
    assert one.refreshed().automaton.match("idiot") == (0, 0) and len(one.automaton.sets) < 100
