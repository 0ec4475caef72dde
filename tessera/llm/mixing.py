"""Mixing overlapping sources to target weights by min-cost flow.

Documents with the same set of sources form a membership pattern. The flow runs
from patterns to sources: a pattern's words can be used ``repeats`` times, each
further time at a higher cost (convex), and a source takes up to its target.
Costs lie on the arcs into patterns alone, so augmenting one level of repetition
after the other gives a flow of least cost. Within a pattern, documents are
taken in the order of a seeded hash until its flow is spent; the document at the
cut gives only its first words.

Only sums by pattern reach the driver, never documents: a row for each set of
sources, at most ``MOST_PATTERNS`` (more is an error that asks for coarser
sources, as the flow is found there). The cut is found by narrowing 1024 ranges of
the hash twice; an order is made only within the last range, so that no task sees
a whole hot source. Rows that share the hash because they share the id (or have
none) are counted there as one group for each size, and the cut inside such a
group is found by narrowing in the same way over the rows' numbers.

Cases: a null text has size 0 and none is taken; a text is counted whole, however
long. A document of no source (null) forms a source of its own, weighed last.
Repeated rows are separate documents; which of several rows alike in id, size and
sources are taken is left open, how many isn't. An empty table gives no rows; if
all sizes are 0 so are all targets. Only the columns named are read; ``spread``
keeps all columns, whatever their names. Ids are of any type that can be hashed.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import unused, written

#: The hash order has 2 * LEVEL_BITS bits for the ranges and LEVEL_BITS more for the order in the last.
LEVEL_BITS = 10
RANGES = 1 << LEVEL_BITS
#: Patterns up to which the table of cuts is broadcast.
BROADCAST_PATTERNS = 10_000
#: Sets of sources at most.
MOST_PATTERNS = 1_000_000


def targets(sizes: dict, weights: dict, share: float, cap: float) -> dict:
    """Each source's target: ``share`` times all sizes by weight; what exceeds ``cap`` times a source's size goes to the others by weight, until none is above."""
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        out |= {s: float(cap * sizes[s]) for s in over}
        left, open_ = left - sum(out[s] for s in over), open_ - over
    return out


def flow(patterns: dict, quotas: dict, members: dict, repeats: int) -> dict:
    """Words from each pattern to each source, {(pattern, source): words}, at the least cost of repetition. patterns: words by pattern; quotas: words by source; members: the sources of each pattern."""
    of_source: dict = {}
    for p, sources in members.items():
        for s in sources:
            of_source.setdefault(s, []).append(p)
    used, met, sent = dict.fromkeys(patterns, 0), dict.fromkeys(quotas, 0), {}
    for level in range(1, repeats + 1):
        free = deque(p for p in patterns if used[p] < level * patterns[p])
        while free:
            start = free[0]
            came, queue, end = {("p", start): None}, deque([("p", start)]), None
            while queue and end is None:
                side, x = here = queue.popleft()
                if side == "p":
                    steps = [("s", s) for s in members[x]]
                elif met[x] < quotas[x]:
                    end = here
                    break
                else:  # a full source can give back what another pattern sent it
                    steps = [("p", p) for p in of_source[x] if sent.get((p, x), 0) > 0]
                for y in steps:
                    if y not in came:
                        came[y] = here
                        queue.append(y)
            if end is None:
                free.popleft()
                continue
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            room = min(level * patterns[start] - used[start], quotas[end[1]] - met[end[1]])
            room = min([room, *(sent[path[i + 1][1], path[i][1]] for i in range(1, len(path) - 1, 2))])
            for i in range(0, len(path) - 1, 2):
                sent[path[i][1], path[i + 1][1]] = sent.get((path[i][1], path[i + 1][1]), 0) + room
                if i + 2 < len(path):
                    sent[path[i + 2][1], path[i + 1][1]] -= room
            used[start] += room
            met[end[1]] += room
            if used[start] >= level * patterns[start]:
                free.popleft()
    return {k: v for k, v in sent.items() if v}


def cut(rows: DataFrame, digit: str, *before: str) -> DataFrame:
    """For each pattern, the range of ``digit`` at which its rest is spent, and the rest left there. A window over at most RANGES sums for each pattern."""
    sums = rows.groupBy("pattern", "rest", *before, digit).agg(F.sum("size").alias("sum"))
    order = Window.partitionBy("pattern").orderBy(digit)
    sums = sums.withColumn("spent", F.sum("sum").over(order) - F.col("sum"))
    return sums.filter(F.col("rest").between(F.col("spent"), F.col("spent") + F.col("sum") - 1)).select("pattern", *before, digit, (F.col("rest") - F.col("spent")).alias("rest"))


def narrowed(pending: DataFrame, first: str, second: str, few) -> DataFrame:
    """(pattern, first, second, rest): the cut of each pattern among the 2 ** (2 * LEVEL_BITS) ranges of two digits, written."""
    once = cut(pending, first)
    return written(cut(pending.drop("rest").join(few(once), ["pattern", first]), second, first), "cuts")


def digits(key: Column, *levels: int) -> list[Column]:
    """Groups of LEVEL_BITS bits of a hash."""
    return [F.shiftright(key, k * LEVEL_BITS).bitwiseAND(RANGES - 1).cast("int") for k in levels]


def pattern_of(groups: Column) -> Column:
    """A text that names a set of sources; null is a source too."""
    return F.to_json(F.array_sort(F.array_distinct(groups)))


def sized(docs: DataFrame, id_col: str, size: Column, groups: Column, seed: int) -> DataFrame:
    """(id, size, pattern, sources, digits of the seeded hash and of the row's number), written in the shared folder: the texts are read once."""
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), pattern_of(groups).alias("pattern"), F.array_distinct(groups).alias("sources"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    named = zip(("d1", "d2", "r1", "r2"), (*digits(F.col("key"), 2, 1), *digits(F.xxhash64("row"), 2, 1)))
    return written(rows.withColumns(dict(named)), "sized")


def take(rows: DataFrame, plan: list[tuple[str, int, int]]) -> DataFrame:
    """The rows of ``sized`` with ``taken``: for each pattern of the plan (pattern, whole repeats, rest) every document's repeats, and once more the documents first in the hash order until the rest is spent."""
    spark = rows.sparkSession
    want = spark.createDataFrame(plan, "pattern string, whole long, rest long")
    few = F.broadcast if len(plan) <= BROADCAST_PATTERNS else (lambda df: df)
    pending = rows.filter("size > 0").join(few(want.filter("rest > 0").select("pattern", "rest")), "pattern")
    at = narrowed(pending, "d1", "d2", few)
    # in the last range: the group of rows alike at which the rest is spent
    order = Window.partitionBy("pattern").orderBy("key", "id", "size")
    inside = pending.drop("rest").join(few(at), ["pattern", "d1", "d2"])
    alike = inside.groupBy("pattern", "d1", "d2", "key", "id", "size", "rest").agg((F.count("*") * F.col("size")).alias("sum")).withColumn("spent", F.sum("sum").over(order) - F.col("sum"))
    group = written(alike.filter(F.col("rest").between(F.col("spent"), F.col("spent") + F.col("sum") - 1)).select("pattern", F.col("key").alias("c_key"), F.col("id").alias("c_id"), F.col("size").alias("c_size"), (F.col("rest") - F.col("spent")).alias("rest")), "groups")
    same = (F.col("key") == F.col("c_key")) & F.col("id").eqNullSafe(F.col("c_id")) & (F.col("size") == F.col("c_size"))
    members = inside.drop("rest").join(few(group), "pattern").filter(same)
    rank = Window.partitionBy("pattern").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    last = narrowed(members, "r1", "r2", few)
    ends = members.drop("rest").join(few(last), ["pattern", "r1", "r2"]).withColumn("spent", F.coalesce(F.sum("size").over(rank), F.lit(0)))
    # the row at which the rest is spent gives a part of its words
    end = written(ends.filter(F.col("rest").between(F.col("spent"), F.col("spent") + F.col("size") - 1)).select("pattern", F.struct("d1", "d2", "key", "id", "size", "r1", "r2", "row").alias("end"), (F.col("rest") - F.col("spent")).alias("part")), "ends")
    here = F.struct("d1", "d2", "key", "id", "size", "r1", "r2", "row")
    marked = rows.join(few(want.select("pattern", "whole")), "pattern", "left").join(few(end), "pattern", "left")
    once = F.when(here < F.col("end"), F.col("size")).when(F.col("row") == F.col("end.row"), F.col("part")).otherwise(0)
    taken = F.coalesce("whole", F.lit(0)) * F.col("size") + F.coalesce(once, F.lit(0))
    return marked.select("id", "size", "pattern", "sources", taken.alias("taken"))


def mix(docs: DataFrame, size: Column, groups: Column, weigh, share: float = 1.5, cap: int = 2, seed: int = 0, id_col: str = "doc_id") -> tuple[DataFrame, dict, dict]:
    """Chooses how many words of each document a mix takes.

    ``size``: words of a document; ``groups``: the array of its sources;
    ``weigh``: gives the weights {source: weight} for the list of sources.
    Returns (id, size, pattern, sources, taken), the sizes and the targets by
    source. No document is taken more than ``cap`` times.
    """
    rows = sized(docs, id_col, size, groups, seed)
    sums = rows.groupBy("pattern", "sources").agg(F.sum("size").alias("words")).limit(MOST_PATTERNS + 1).collect()  # a row for each pattern
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources: name coarser ones")
    patterns, members, sizes = {}, {}, {}
    for pattern, sources, words in sums:
        patterns[pattern] = patterns.get(pattern, 0) + words
        members[pattern] = sources
        for s in sources:
            sizes[s] = sizes.get(s, 0) + words
    wanted = targets(sizes, weigh([*sizes]), share, cap) if sizes else {}
    sent = flow(patterns, {s: round(t) for s, t in wanted.items()}, members, cap)
    spent = {}
    for (p, _), words in sent.items():
        spent[p] = spent.get(p, 0) + words
    plan = [(p, *divmod(words, patterns[p])) for p, words in spent.items()]
    return take(rows, plan), sizes, wanted


def spread(docs: DataFrame, size: Column, groups: Column, weigh, share: float = 1.5, cap: int = 2, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its words, to the nearest whole: texts aren't cut. Rows without words go; rows alike in id, size and sources come as often as the one taken most."""
    taken, _, _ = mix(docs, size, groups, weigh, share, cap, seed, id_col)
    of, words, pattern, times, copy = unused(docs.columns, "of", "words", "pattern", "times", "copy")
    often = taken.filter("taken > 0").groupBy("id", "size", "pattern").agg(F.floor(F.max("taken") / F.col("size") + 0.5).cast("int").alias(times))
    often = often.filter(F.col(times) > 0).select(F.col("id").alias(of), F.col("size").alias(words), F.col("pattern").alias(pattern), times)
    same = F.col(id_col).eqNullSafe(F.col(of)) & (size == F.col(words)) & pattern_of(groups).eqNullSafe(F.col(pattern))
    return docs.join(often, same).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)


def by_order(weights: tuple = (5, 2, 1)):
    """Weights that repeat over the sources by code point, null last."""

    def weigh(sources: list) -> dict:
        order = sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]
        return {s: weights[i % len(weights)] for i, s in enumerate(order)}

    return weigh


def with_targets(taken: DataFrame, sizes: dict, wanted: dict) -> DataFrame:
    """For documents of one source each: its size and target beside what is taken."""
    spark = taken.sparkSession
    table = spark.createDataFrame([(s, sizes[s], wanted[s]) for s in sizes], "source string, source_size long, target double")
    few = F.broadcast(table) if len(sizes) <= BROADCAST_PATTERNS else table
    rows = taken.withColumn("of", F.col("sources")[0])
    return rows.join(few, rows["of"].eqNullSafe(few["source"])).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
