"""Quality rules: base limits, then a decision list learned from labelled statistics.

Statistics of each text are Spark expressions on the row itself, so nothing is
shuffled. Sequential covering grows conjunctions of thresholds on two thirds of
the labelled rows (gain of first-order learners), prunes them on the last third,
and takes the rows that a rule covers away before the next. The list comes out as
one ordered Spark conditional expression. Only statistics of at most ``sample``
labelled rows reach the driver; the verdict runs on every document.

Cases: a null or empty text has no words, so the base rules reject it. Without
labels, or with labels of one kind, the list is empty and the base rules decide.
Repeated rows stay separate rows. Columns besides the id and the text don't
matter. Of thresholds with equal gain the first in the order of FEATURES is taken,
of labelled rows with equal hashes the lesser id; a document that meets several
rules has the first one's number. Ids are of the labels' type. Neither rules nor
their conditions are limited in number. Array functions work on one text at a time; equal lines and repeated
windows are found by hashing and sorting, so that a long text isn't compared
with itself pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, text_or_empty, words

#: Labelled rows that the rules are learned from, at most; chosen by a hash of the id.
SAMPLE = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rates that tell sound text from noise whatever its language (so not the length of words).
FEATURES = ("n_words", "symbols", "dup_lines", "repeats", "shouts", "capitals", "digits")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), lambda x: then(x))[0]


def without(text: Column, expression: str) -> Column:
    return F.length(F.regexp_replace(text, expression, "")).cast("long")


def covered(starts: Column) -> Column:
    """Words in the three-word windows that begin at these ascending places."""
    steps = F.transform(starts, lambda p, i: F.when(i + 1 < F.size(starts), F.least(F.lit(3), starts[i + 1] - p)).otherwise(3))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def repeated(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def places(ordered: Column) -> Column:
        twin = lambda x, i: ((i > 0) & (ordered[i - 1]["h"] == x["h"])) | ((i + 1 < F.size(ordered)) & (ordered[i + 1]["h"] == x["h"]))
        return F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["at"]))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(let(ordered, places), covered))


def repeat_words(found: Column) -> Column:
    """Words of the array that lie in a three-word window found twice or more. Windows are compared by 64-bit hashes."""
    windows = F.transform(F.slice(found, 1, F.greatest(F.size(found) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, found[i + 1], found[i + 2]))
    return let(windows, repeated)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *beside: str) -> DataFrame:
    """(doc_id, base statistics, further counts, columns named besides) of each whole text. No shuffle, no Python on the executors."""
    text = text_or_empty(text_col)
    with_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        *beside,
        let(words(text), of_words).alias("w"),
        let(with_word, of_lines).alias("l"),
        without(text, SPACE_CLASS).alias("word_chars"),
        without(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        without(text, r"[^!?]+").alias("n_shouts"),
        without(text, r"[^\p{Lu}]+").alias("n_capitals"),
        without(text, r"[^0-9]+").alias("n_digits"),
    )
    return rows.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_shouts", "n_capitals", "n_digits", *beside)


def features(stats: DataFrame) -> DataFrame:
    """The rates that rules set thresholds on, beside the statistics."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return stats.withColumns({
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "shouts": per("n_shouts", "n_words"),
        "capitals": per("n_capitals", "word_chars"),
        "digits": per("n_digits", "word_chars"),
    })


def labelled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str = "doc_id", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled documents, in the order of the ids' hash."""
    chosen = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).alias("label")).orderBy(F.xxhash64(id_col), id_col, "label").limit(sample)
    # the broadcast side has at most `sample` rows
    few = docs.join(F.broadcast(chosen.select(id_col).distinct()), id_col, "left_semi")
    rows = features(statistics(few, id_col)).select("doc_id", *FEATURES).join(chosen.withColumnRenamed(id_col, "doc_id"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", *FEATURES).limit(sample).collect()
    return np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows], int)


Rule = list[tuple[int, str, float]]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (x[:, f] >= t if sign == ">=" else x[:, f] <= t for f, sign, t in rule), np.ones(len(x), bool))


def grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray]) -> Rule:
    """Adds the threshold with the largest gain until no good row is covered or nothing is gained."""
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        before, top = np.log2(p0 / (p0 + n0)) if p0 else 0.0, (1e-9, None)
        for f, places in enumerate(cuts):
            for t in places:
                for sign in (">=", "<="):
                    now = inside & (x[:, f] >= t if sign == ">=" else x[:, f] <= t)
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    if p:
                        top = max(top, (p * (np.log2(p / (p + n)) - before), (f, sign, float(t))), key=lambda y: y[0])
        if top[1] is None:
            break
        rule.append(top[1])
        inside &= holds([top[1]], x)
    return rule


def worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    found = holds(rule, x)
    p, n = (found & bad).sum(), (found & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drops conditions from the end while the rule does as well on rows that it wasn't grown on."""
    while len(rule) > 1 and worth(rule[:-1], x, bad) >= worth(rule, x, bad):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, labels: np.ndarray, least: int = 5, precision: float = 0.97) -> list[Rule]:
    """The ordered rules that reject, from features and labels (1 is good)."""
    bad, rules, left = labels == 0, [], np.ones(len(labels), bool)
    if not bad.any() or bad.all():
        return rules
    grown = np.arange(len(labels)) % 3 != 2

    def sound(rule: Rule) -> bool:
        found = holds(rule, x) & left
        p = (found & bad).sum()
        return bool(p >= least and p >= precision * found.sum() and not ((b & bad).any() and worth(rule, x[b], bad[b]) <= 0))

    passed_over: set[int] = set()  # features that a rule began with which wasn't precise
    while (left & bad).sum() >= least:
        a, b = left & grown, left & ~grown
        edges = [np.unique(np.quantile(x[a & bad, f], np.linspace(0, 1, 21))) if f not in passed_over and (a & bad).any() else [] for f in range(x.shape[1])]
        full = grow(x[a], bad[a], edges)
        if not full:
            break
        # a shorter rule counts only if it is precise too
        rule = next((r for r in (prune(full, x[b], bad[b]), full) if sound(r)), None)
        if rule:
            rules.append(rule)
            left &= ~holds(rule, x)
            passed_over.clear()
        else:
            passed_over.add(full[0][0])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that holds, 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = reduce(Column.__and__, (F.col(FEATURES[f]) >= t if sign == ">=" else F.col(FEATURES[f]) <= t for f, sign, t in rule))
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics, base_failed, rule, kept) of every document."""
    judged = features(statistics(docs, id_col, text_col)).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
