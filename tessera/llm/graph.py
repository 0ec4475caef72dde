"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the least among itself and its neighbours."""
    both = edges.select("hi", "lo").union(edges.select("lo", "hi")).toDF("u", "w")
    least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("w > u").join(least, "u").select(F.col("w").alias("hi"), F.col("m").alias("lo"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo")))


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(hi, lo))"), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """(v, component) for each vertex of the links (a, b): the least vertex that it can reach. A hot vertex's neighbours are added up before they meet, and joins on it can be split; each round is written in the shared folder."""
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        edges = written(small_star(large_star(edges).distinct()).distinct(), "edges", replaces=edges)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("hi").alias("v"), F.col("lo").alias("component")).union(edges.select("lo", "lo")).distinct()
