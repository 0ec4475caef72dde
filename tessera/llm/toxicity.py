"""Toxicity of whole texts: a learned lexicon, matched with misspellings and weighed by context.

The lexicon comes from labelled texts: words, and stems that inflected words
begin with, that toxic texts have far more often than others, chosen by
covering the toxic texts again and again; where a stem tells no more than a
word, the word is taken, and the words of a stem that is taken are entries too,
as stems are read without edits. Its trie is intersected with
Levenshtein automata: a state is the set of trie places with the edits spent, and
transitions are worked out once and kept, so a word costs a look-up for each
letter until its state dies. An entry that clean texts have words near to is read
without edits. Around each hit a window of text tells quotation
(quote signs on both sides, words of reporting) from abuse. Scores come from a
logistic model of the weighed hits.

The lexicon is chosen from every key of the labelled sample that tells toxic texts;
only the sample is bounded, by SAMPLE. A worker's tasks share one automaton.

Cases: a null or empty text has no hits and the score of such texts. Very long
texts are read whole; a hit's context is its window alone. Of entries as near to
a word the one with fewer edits counts, then the one chosen first; an exact stem
comes before an edited word. ``keep`` replaces a column tox_score of the input,
all others stay. Ids are of any type. With no
labels, or labels of one kind, the lexicon is empty and the score is the rate of
toxic labels (0 without labels). Repeated rows stay separate rows. Only the id
and text columns are read; labels, languages and sources are never inputs of a
score. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Labelled rows that the lexicon and the model are learned from, at most; chosen by a hash of the id.
SAMPLE = 20_000
#: States of an automaton that a worker remembers; with more it begins anew.
STATES = 200_000
#: Shortest and longest stem; letters from which one edit, or two, are a misspelling.
STEM = (4, 8)
ONE_EDIT, TWO_EDITS = 5, 9
#: Code points on either side of a hit that tell quotation.
WINDOW = 80
#: Logarithm of how much more often toxic texts have an entry than others, at least.
LIFT = 2
#: Toxic texts are covered until each has so many entries.
COVER = 3
ROWS = 512

_word = re.compile(r"[^\W\d_]+")
#: Signs that open and close quotations, and words of reporting.
_opening, _closing = set("\"“„«‘'"), set("\"”“»’'")
_reporting = re.compile(r"\b(?:said|says|wrote|writes|quote[ds]?|quoting|called|sagte|schrieb|zitiert|dit|écrit|cite|citation|dijo|escribió|cita)\b", re.I)

DEAD = 0


class Automaton:
    """The trie of the entries, intersected with the Levenshtein automata of the words that it reads."""

    def __init__(self, entries: list[str], exact: frozenset[int] = frozenset()) -> None:
        """exact: entries that are read without edits."""
        self.children: list[dict[str, int]] = [{}]
        self.end: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.limit: dict[int, int] = {}
        for k, entry in enumerate(entries):
            word, node = entry.rstrip("*"), 0
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            if entry.endswith("*"):
                self.stem[node] = k
            else:
                self.end[node] = k
                self.limit[node] = 0 if k in exact else (len(word) >= ONE_EDIT) + (len(word) >= TWO_EDITS)
        # edits that can still end at an entry below a place
        self.most = [0] * len(self.children)
        for node in reversed(range(len(self.children))):
            self.most[node] = max([self.limit.get(node, 0), *(self.most[c] for c in self.children[node].values())])
        self.states: dict[frozenset, int] = {frozenset(): DEAD}
        self.sets: list[frozenset] = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        self.found: list[tuple[int, int] | None] = [None]
        self.start = self.state({0: 0})

    def state(self, places: dict[int, int]) -> int:
        """The number of a set of places, with letters left out of the word (each one edit) followed."""
        todo = list(places)
        while todo:
            node = todo.pop()
            spent = places[node]
            for child in self.children[node].values():
                if spent < self.most[child] and places.get(child, 9) > spent + 1:
                    places[child] = spent + 1
                    todo.append(child)
        key = frozenset(places.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(spent, self.end[n]) for n, spent in key if n in self.end and spent <= self.limit[n]]
            self.found.append(min(ends) if ends else None)
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        places: dict[int, int] = {}

        def put(node: int, spent: int) -> None:
            if spent <= self.most[node] and spent < places.get(node, 9):
                places[node] = spent

        for node, spent in self.sets[state]:
            put(node, spent + 1)
            for letter, child in self.children[node].items():
                if letter == c:
                    if spent == 0 or spent <= self.most[child]:
                        places[child] = min(places.get(child, 9), spent)
                else:
                    put(child, spent + 1)
        self.steps[state][c] = out = self.state(places)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry; a stem counts if the word begins with it."""
        stem, node = None, 0
        if self.stem:
            for c in word:
                node = self.children[node].get(c, -1)
                if node < 0:
                    break
                if node in self.stem:
                    stem = (0, self.stem[node])
        state, steps = self.start, self.steps
        for c in word:
            following = steps[state].get(c)
            state = self.step(state, c) if following is None else following
            if state == DEAD:
                return stem
        found = self.found[state]
        return found if stem is None or (found and found[0] == 0) else stem


def keys_of(text: str) -> set[str]:
    """The words of a text and the stems of its longer words."""
    words = {w for w in _word.findall(text.lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit stands in a quotation: signs in the window before it are paired, and one is open at the hit and closed after it; or one of the two stands beside a word of reporting."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    held = 0  # quotations open at the hit; a sign closes if one is open and no letter follows it
    for k, c in enumerate(before):
        if c in _closing and held and not before[k + 1 : k + 2].isalnum() and (k == 0 or not before[k - 1].isspace()):
            held -= 1
        elif c in _opening and (k == 0 or not before[k - 1].isalnum()):
            held += 1
    # after the hit the first sign tells: it closes what is open unless it opens anew
    closes = False
    for k, c in enumerate(after):
        if c in _closing and not after[k + 1 : k + 2].isalnum() and (k == 0 or not after[k - 1].isspace()):
            closes = True
            break
        if c in _opening and (k == 0 or not after[k - 1].isalnum()):
            break
    return bool(held and closes) or bool(held or closes) and bool(_reporting.search(before) or _reporting.search(after))


@dataclass
class Model:
    entries: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    #: Weights of misspelled entries; 0: the entry is read without edits.
    missed: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=lambda: [0.0] * 5)
    scale: list[float] = field(default_factory=lambda: [1.0] * 5)
    slopes: list[float] = field(default_factory=lambda: [0.0] * 5)
    bias: float = -20.0

    def __post_init__(self) -> None:
        self.automaton = Automaton(self.entries, frozenset(k for k, v in enumerate(self.missed) if not v))

    def __reduce__(self):
        return remembered, (*map(tuple, (self.entries, self.weights, self.missed, self.mean, self.scale, self.slopes)), self.bias)

    def refreshed(self) -> Model:
        """The model, with its automaton's states forgotten if they have become too many."""
        if len(self.automaton.sets) > STATES:
            self.__post_init__()
        return self

    def found(self, text: str) -> set[int]:
        """The entries in a text, misspelled ones too."""
        hits = map(self.automaton.match, set(_word.findall(text.lower())))
        return {hit[1] for hit in hits if hit is not None}

    def features(self, text: str) -> list[float]:
        """Weighed hits that are abuse, that are quoted, both on a scale of logarithms; whether any is abuse, as one term is enough; hits for each word; words."""
        lowered = text.lower()
        tokens = _word.findall(lowered)
        match, found = self.automaton.match, {}
        for word in set(tokens):
            if (hit := match(word)) is not None:
                found[word] = hit
        if not found:
            return [0.0, 0.0, 0.0, 0.0, math.log1p(len(tokens))]
        abuse, cited = Counter(), Counter()
        signs = any(c in lowered for c in "\"“„«‘'")
        for m in _word.finditer(lowered):
            if m[0] in found:
                edits, entry = found[m[0]]
                kind = cited if signs and quoted(lowered, *m.span()) else abuse
                kind[entry, edits > 0] += 1
        weighed = [sum((self.missed if misspelled else self.weights)[k] * math.log1p(n) for (k, misspelled), n in kind.items()) for kind in (abuse, cited)]
        return [*map(math.log1p, weighed), float(bool(abuse)), sum(abuse.values()) / len(tokens), math.log1p(len(tokens))]

    def score(self, text: str) -> float:
        z = self.bias + sum(s * (x - m) / d for s, x, m, d in zip(self.slopes, self.features(text), self.mean, self.scale))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@lru_cache(maxsize=2)
def remembered(*parts) -> Model:
    """A worker's tasks share a model, and so the states that its automaton has been in."""
    return Model(*map(list, parts[:-1]), parts[-1])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of this task's labelled texts: toxic texts and others that have them."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if label else other).update(keys_of(text or ""))
    keys = [*(toxic.keys() | other.keys())]
    for at in range(0, len(keys), 10_000):
        part = keys[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[k] for k in part], pa.int64()), pa.array([other[k] for k in part], pa.int64())], names=["key", "toxic", "other"])


def nested(keys: list[str]) -> list[list[int]]:
    """For each key, the stems that it begins with and, for a stem, the keys that begin with it."""
    stems = {key[:-1]: k for k, key in enumerate(keys) if key.endswith("*")}
    out: list[list[int]] = [[] for _ in keys]
    for k, key in enumerate(keys):
        letters = key.rstrip("*")
        for n in range(STEM[0], min(STEM[1], len(letters)) + 1):
            if (j := stems.get(letters[:n], k)) != k:
                out[k].append(j)
                out[j].append(k)
    return out


def choose(candidates: list[tuple[str, int, int]], texts: list[list[int]], n_toxic: int, n_other: int) -> tuple[list[str], list[float]]:
    """Entries that cover the toxic texts (each a list of candidates' numbers) COVER times, those with most weight on uncovered texts first, and of equal ones that of most letters; nested ones count once for a text. The other candidates that are words follow, those of a chosen stem first, so that all are read with edits too. Nothing but the labelled texts bounds their number."""
    keys = [key for key, _, _ in candidates]
    odds = [math.log((t + 0.5) / (n_toxic + 1)) - math.log((o + 0.5) / (n_other + 1)) for _, t, o in candidates]
    related, size = nested(keys), [(len(key.rstrip("*")), not key.endswith("*"), key) for key in keys]
    inside: list[set[int]] = [set() for _ in candidates]
    for i, found in enumerate(texts):
        for k in found:
            inside[k].add(i)
    need, chosen = [COVER] * len(texts), []
    # texts that a candidate would cover, and how often these still need covering in all
    opened, wanted = [set(found) for found in inside], [COVER * len(found) for found in inside]
    left = set(range(len(keys)))
    while left:
        k = max(left, key=lambda j: (wanted[j] * odds[j], size[j]))
        if len(opened[k]) < 3:
            break
        chosen.append(k)
        left.remove(k)
        for i in sorted(opened[k]):
            need[i] -= 1
            for j in texts[i]:
                if i in opened[j]:
                    wanted[j] -= 1
                    if not need[i]:
                        opened[j].remove(i)
        for j in related[k]:
            for i in opened[j] & inside[k]:
                wanted[j] -= need[i]
                opened[j].remove(i)
    words = (j for k in chosen if keys[k].endswith("*") for j in related[k] if not keys[j].endswith("*"))
    entries = list(dict.fromkeys([*chosen, *words]))
    taken = set(entries)
    others = [k for k, key in enumerate(keys) if k not in taken and not key.endswith("*")]
    entries += others
    return [keys[k] for k in entries], [min(odds[k], 6.0) for k in entries]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[list[float], list[float], list[float], float]:
    """Mean, scale, slopes and bias of a penalized logistic model, by Newton's method."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(a.shape[1]), np.r_[np.full(x.shape[1], penalty), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        change = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += change
        if np.abs(change).max() < 1e-8:
            break
    return mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of at most ``sample`` labelled texts, which are written in the shared folder for the passes over them."""
    chosen = labels.filter(F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64(id_col), id_col, "label").limit(sample)
    # the broadcast side has at most `sample` rows
    texts = written(docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select("text", "label"), "labelled")
    by_label = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}
    n_toxic, n_other = by_label.get(1, 0), by_label.get(0, 0)
    if not n_toxic or not n_other:
        return Model(bias=30.0 if n_toxic else -30.0)
    counts = texts.mapInArrow(counted, "key string, toxic long, other long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    often = counts.filter(F.col("toxic") >= max(3, n_toxic // 500)).withColumn("lift", lift).filter(F.col("lift") > LIFT)
    # keys of the labelled texts, which ``sample`` bounds
    candidates = [(r.key, r.toxic, r.other) for r in often.orderBy(F.desc(F.col("lift") * F.col("toxic")), F.length("key"), "key").collect()]
    number = {key: k for k, (key, _, _) in enumerate(candidates)}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(number[k] for k in keys_of(t or "") if k in number) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["found"])

    # numbers alone, of the toxic texts of the sample
    covered = [r.found for r in texts.filter("label = 1").select("text").distinct().mapInArrow(incidence, "found array<int>").collect()]
    entries, weights = choose(candidates, sorted(covered), n_toxic, n_other)
    open_to_edits = Model(entries, weights, weights)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of this task's texts: for each entry, the toxic ones and others that have it or a misspelling of it."""
        had = np.zeros((len(entries), 2), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in open_to_edits.found(text or ""):
                    had[k, 0 if label else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(entries)), pa.int32()), pa.array(had[:, 0]), pa.array(had[:, 1])], names=["entry", "toxic", "other"])

    # labelled texts seldom have misspellings: they count as their entry as long as the words near it tell toxic texts as well
    near_lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    lifts = {r.entry: r.lift for r in texts.mapInArrow(near, "entry int, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).select("entry", near_lift.alias("lift")).collect()}
    missed = [min(lifts[k], 6.0) if lifts[k] > LIFT else 0.0 for k in range(len(entries))]
    draft = Model(entries, weights, missed)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [draft.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    rows = sorted((r.x, r.label) for r in texts.mapInArrow(measured, "x array<double>, label int").collect())
    return Model(entries, weights, missed, *logistic(np.array([x for x, _ in rows]), np.array([y for _, y in rows], float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, score) of each whole text; with ``keep``, all columns and ``tox_score``. No shuffle."""
    source = docs.drop("tox_score") if keep else docs.select(id_col, text_col)
    at, names = source.columns.index(text_col), source.columns if keep else [id_col]
    out = "tox_score" if keep else "score"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                model.refreshed()
                scores = [model.score(t or "") for t in rows.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(rows.columns if keep else rows.columns[:1]), pa.array(scores, pa.float64())], names=[*names, out])

    return source.mapInArrow(run, ", ".join([*(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in names), f"{out} double"]))


def held_out(id_col: str = "doc_id"):
    """Whether a document's label isn't learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.filter(~held_out(id_col))
