"""Quality by hierarchical empirical Bayes: a document's own evidence and its site's record.

Labels counted by path and host give rates; each level is shrunk toward the one
above with a strength fitted from the spread of the rates (method of moments for
the beta-binomial), hosts toward the corpus and paths toward their host, so a
sparse site says little. A document's log odds are those of a logistic model of
its statistics plus what its path's posterior adds to the corpus's. A document's
own labels are left out of the posteriors that judge it (not out of the corpus's
rate, the two strengths and the model, which are a few numbers each).

Labels are counted in one pass, by path; hosts and strengths come from these sums.

Cases: a null host or path is a site of its own; a site without other labels has
the posterior of the level above. Without labels the rate is 1/2 and every
document is kept. Null and empty texts are judged by the statistics of an empty
text; very long texts are measured whole, without comparing a text with itself.
A document with several labels counts as often. Rows that share an id share its
labels, each row being a document; a row without an id has none. A score at the
threshold is kept. Repeated rows stay separate rows; the site columns are given
by expressions, so names of further columns don't matter. Ids are of the labels'
type. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.quality_rules import FEATURES, SAMPLE, features, labelled, statistics
from tessera.llm.toxicity import logistic

#: Strength of a prior, in labels, at least and at most.
STRENGTH = (1.0, 10_000.0)


def strength(groups: DataFrame, rate: Column) -> Column:
    """Labels that the prior counts as: m(1-m)/v - 1 for the variance v of the true rates, from the spread of the rates less what sampling adds. ``groups`` has n and good."""
    m = F.sum("good") / F.sum("n")
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - rate, F.lit(2)))
    noise = F.count("*") * m * (1 - m)
    pairs = F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")
    variance = F.when(pairs > 0, (spread - noise) / pairs)
    return F.when(variance > 0, F.least(F.greatest(m * (1 - m) / variance - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(STRENGTH[1])


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without a leading www; null if there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def path_of(url: Column, depth: int = 1) -> Column:
    """The first ``depth`` folders of a url's path, without its file; null for a url that isn't one."""
    folders = F.filter(F.split(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), r"[^/]*$", ""), "/"), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(F.slice(folders, 1, depth), "/"))


@dataclass(frozen=True)
class Sites:
    """Labels (n) and good ones among them by path and by host, the corpus's rate and the strengths of hosts' and paths' priors."""

    by_path: DataFrame
    by_host: DataFrame
    rate: float
    host_strength: float
    path_strength: float

    def host_rate(self, n: Column, good: Column) -> Column:
        return (good + self.host_strength * self.rate) / (n + self.host_strength)

    def path_rate(self, n: Column, good: Column, host_rate: Column) -> Column:
        return (good + self.path_strength * host_rate) / (n + self.path_strength)


def sites(labelled_sites: DataFrame) -> Sites:
    """From (host, path, label). Sums by path, then by host: a hot site's labels are added up before they are shuffled. The labels are read once; what follows reads the sums, which are written."""
    paths = written(labelled_sites.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("good")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    if not total["n"]:
        return Sites(paths, hosts, 0.5, STRENGTH[1], STRENGTH[1])
    rate = (total["good"] + 1) / (total["n"] + 2)
    host_strength = hosts.agg(strength(hosts, F.lit(rate)).alias("k")).first()["k"]
    at_host = Sites(paths, hosts, rate, host_strength, STRENGTH[1])
    above = hosts.select(F.col("host").alias("of"), at_host.host_rate(F.col("n"), F.col("good")).alias("host_rate"))
    inner = paths.join(above, F.col("host").eqNullSafe(F.col("of")))
    path_strength = inner.agg(strength(inner, F.col("host_rate")).alias("k")).first()["k"]
    return Sites(paths, hosts, rate, host_strength, path_strength)


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def evidence(model: tuple) -> Column:
    """The logistic model's log odds as an expression of the statistics."""
    mean, scale, slopes, bias = model
    return reduce(Column.__add__, (F.lit(s) * (F.log1p(F.col(f)) - m) / d for f, m, d, s in zip(FEATURES, mean, scale, slopes)), F.lit(bias))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> tuple:
    x, y = labelled(docs, labels, sample, id_col, label_col)
    if not len(y) or y.min() == y.max():
        n = len(FEATURES)
        return [0.0] * n, [1.0] * n, [0.0] * n, 0.0
    return logistic(np.log1p(x), y.astype(float))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, score, kept): the document's own log odds, the posteriors of its site and what they come to."""
    model = fit(docs.select(F.col(id_col), F.col(text_col)), labels, sample, id_col, label_col)
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("of"), F.col(label_col).alias("label"))
    of = docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    found = sites(of.join(known, F.col("id") == F.col("of")).select("host", "path", "label"))
    stats = features(statistics(docs.select(F.col(id_col), F.col(text_col), F.struct(host.alias("host"), path.alias("path")).alias("site")), id_col, text_col, "site"))
    judged = stats.select("doc_id", evidence(model).alias("evidence"), F.col("site.host").alias("host"), F.col("site.path").alias("path"))
    own = known.groupBy("of").agg(F.count("*").alias("own_n"), F.sum("label").alias("own_good"))
    p = found.by_path.toDF("p_host", "p_path", "p_n", "p_good")
    h = found.by_host.toDF("h_host", "h_n", "h_good")
    # how sites join is left to their number; rows of a hot one are split at run time
    joined = judged.join(own, F.col("doc_id") == F.col("of"), "left").join(p, F.col("host").eqNullSafe(F.col("p_host")) & F.col("path").eqNullSafe(F.col("p_path")), "left").join(h, F.col("host").eqNullSafe(F.col("h_host")), "left")
    but_own = lambda c, o: F.coalesce(c, F.lit(0.0)) - F.coalesce(o, F.lit(0))
    rows = joined.withColumn("host_rate", found.host_rate(but_own("h_n", "own_n"), but_own("h_good", "own_good")))
    rows = rows.withColumn("path_rate", found.path_rate(but_own("p_n", "own_n"), but_own("p_good", "own_good"), F.col("host_rate")))
    z = F.col("evidence") + log_odds(F.col("path_rate")) - log_odds(F.lit(found.rate))
    score = 1 / (1 + F.exp(-z))
    return rows.select("doc_id", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= threshold).alias("kept"))
