"""Near-duplicate documents by bottom-k sketches from one hash function.

A text's set is its distinct shingles of five words. Texts with equal sets form a
class, for which the least document stands. Its sketch holds the ``SKETCH``
smallest hashes of the set. Inverted lists of retained values give the pairs that
share some, the union's sketch estimates their likeness, and pairs that may be
near are confirmed on the full sets of their texts. Links make components.

Values in more than ``common`` sketches (passages that many texts share, large
groups of near copies) would give lists whose pairs grow with the square, so a
text is listed under its rarer values: under so many that a pair of likeness 0.75
shares none less than once in a million. A text with too few of these (less than
``RARE`` of its sketch) is in long lists too, under its smallest common values,
with a ``WIDE`` sketch that holds most sets whole. Among these texts the values of
the wide sketches are counted. Pairs that share one of ``common`` texts at most meet
under it. All other pairs share only the rest of their values, which bounds what
they have in common: a text whose own values are more than about a seventh of it is
near no text of its size that way, and the others lie about the core of a group.
So each long list compares its texts with the leaders of their size, the texts with
the fewest values of their own, and near ones join the leader's component. What is
then left outside a list's largest component and within its bound is compared with
the list block by block, so that no task holds more than two blocks and only near
pairs come out of it. Nothing is capped and no list emits all its pairs. Whether a
value is common is found by a join; no table of values passes through the driver.

Cases: a null text is empty; a text without words has no set and is linked with
nothing. A null id is the least. Ids are of any type that has an order; rows that
share one are separate documents, told apart by their texts, and rows equal in
both are one class. Of equal least ids none is preferred. Very long texts are
shingled whole; a task holds the sets of one pair. Only the id and text columns
are read, whatever the names of others; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, written
from tessera.llm.graph import components

SHINGLE = 5
#: Values of a sketch, and those that a text is listed under at least.
SKETCH, KEPT = 64, 16
#: How seldom a pair of likeness 0.75 may share none of the rare values that its texts are listed under.
MISS = 1e-6
#: A value in more sketches than this is common; a text with fewer rare values in its sketch than this share is in long lists.
COMMON, RARE = 50, 0.4
#: Ids up to which the texts to confirm are picked out by a broadcast join.
BROADCAST_IDS = 1_000_000
#: Pairs with a lower estimate aren't confirmed: 6 standard deviations below 0.75 for SKETCH values.
ESTIMATE = 0.42
#: Values of the wide sketch (sets of as many are whole), and the estimate that it asks for: 6 standard deviations below 0.75.
WIDE, WIDE_ESTIMATE = 512, 0.63
#: 6 standard deviations of a share of WIDE values, for the share of 0.75 that near sets have in common at least.
SLACK = 6 * (0.75 * 0.25 / WIDE) ** 0.5
#: Texts of a block of the last comparison, and values that are counted there at once.
BLOCK, COLUMNS = 1024, 4096
#: Parts that the pairs of one text are dealt to for confirmation; each has the text once.
PARTS = 64
ROWS = 256


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 63-bit hashes of the distinct shingles of a text (UTF-8); A-Z count as a-z, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed >> np.uint64(1))


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64)))


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, n, d1, d2, sketch) of (id, t, text): size, digest and sketch of each text's set."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            sets = [shingle_set(t or b"") for t in rows.column(2).cast(pa.binary()).to_pylist()]
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists_of([s[:SKETCH] for s in sets])],
                names=["id", "t", "n", "d1", "d2", "sketch"],
            )


def listed(sketches: DataFrame, common: int) -> DataFrame:
    """(v, n, rare, often): the rare values that a text is listed under, and its smallest common ones if it has few of these."""
    values = sketches.select("v", "n", F.explode("sketch").alias("value"))
    often = written(values.groupBy("value").count().filter(F.col("count") > common).select("value", F.lit(True).alias("common")), "common")
    those = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("value"))))
    is_rare = F.col("common").isNull()
    flagged = values.join(often, "value", "left").groupBy("v", "n").agg(those(is_rare).alias("rare"), those(~is_rare).alias("often"), F.count("*").alias("size"))
    # of texts of likeness 0.75 all values but a quarter are shared; if that quarter is rare, so is this share of the rare ones
    share = F.try_divide("size", 4 * F.size("rare"))
    enough = F.when(share < 1, F.ceil(F.lit(math.log(MISS)) / F.ln(share))).otherwise(SKETCH).cast("int")
    few = F.size("rare") < RARE * F.col("size")
    return flagged.select("v", "n", F.slice("rare", 1, F.greatest(F.lit(KEPT), enough)).alias("rare"), F.when(few, F.slice("often", 1, KEPT)).otherwise(F.array().cast("array<long>")).alias("often"))


def sizes_near(m: str, n: str) -> Column:
    return (4 * F.col(m) >= 3 * F.col(n)) & (4 * F.col(n) >= 3 * F.col(m))


def sharing(posts: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a value which isn't common; such a list has ``common`` texts at most."""
    of = posts.select("v", "n", F.explode("rare").alias("value"))
    other = of.withColumnsRenamed({"v": "b", "n": "m"})
    return of.withColumnRenamed("v", "a").join(other, "value").filter((F.col("a") < F.col("b")) & sizes_near("m", "n")).select("a", "b").distinct()


def estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose union's sketch says that they may be near."""
    x, y = sketches.select(F.col("v").alias("a"), F.col("sketch").alias("x")), sketches.select(F.col("v").alias("b"), F.col("sketch").alias("y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b")
    shared = F.size(F.array_intersect("x", "y"))
    # common values that lie in the union's sketch
    union = F.slice(F.sort_array(F.array_union("x", "y")), 1, SKETCH)
    inside = F.when(shared == 0, 0).otherwise(F.size(F.array_intersect(F.array_intersect("x", "y"), union)) / F.size(union))
    return both.filter(inside >= ESTIMATE).select("a", "b")


def confirming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (b, part, a, text) in order, the pairs whose texts' sets are near; a row without ``a`` has the text of b for the rows that follow."""
    held = np.empty(0, np.uint64)
    for batch in batches:
        found = []
        for b, a, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()):
            one = shingle_set(text or b"")
            if a is None:
                held = one
                continue
            shared = len(np.intersect1d(one, held, assume_unique=True))
            if shared and 100 * shared >= 75 * (len(one) + len(held) - shared):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are near on their full sets. The text of b isn't copied to each of its pairs: it comes once for each part of them, ahead of the texts that it is compared with."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(PARTS)).alias("part"))
    others = dealt.join(texts.withColumnRenamed("v", "a"), "a").select("b", "part", "a", "text")
    held = dealt.select("b", "part").distinct().join(texts.withColumnRenamed("v", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    rows = others.union(held).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
    return rows.mapInArrow(confirming, "a long, b long")


def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, n, wide) of (v, text)."""
    for batch in batches:
        sets = [shingle_set(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), lists_of([s[:WIDE] for s in sets])], names=["v", "n", "wide"])


def wide_near(x: str, y: str, m: str, n: str) -> Column:
    """Whether wide sketches say that two sets of m and n values may be near; they decide it if both sets are whole."""
    shared = F.size(F.array_intersect(x, y))
    union = F.slice(F.sort_array(F.array_union(x, y)), 1, WIDE)
    estimate = F.size(F.array_intersect(F.array_intersect(x, y), union)) / F.size(union)
    whole = (F.col(m) <= WIDE) & (F.col(n) <= WIDE)
    return sizes_near(m, n) & F.when(whole, 100 * shared >= 75 * (F.col(m) + F.col(n) - shared)).otherwise(estimate >= WIDE_ESTIMATE)


def sure() -> Column:
    return ((F.col("n") <= WIDE) & (F.col("m") <= WIDE)).alias("sure")


def capped(long: DataFrame, common: int) -> tuple[DataFrame, DataFrame]:
    """(v, n, often, wide, cap, bucket) of (v, n, often, wide), written; (v, value) of the values in 2 to ``common`` of the wide sketches, written. Texts that share none of these share ``cap`` values at most: those that are common."""
    values = long.select("v", F.explode("wide").alias("value"))
    seldom = written(values.groupBy("value").agg(F.count("*").alias("count"), F.min("v").alias("v")).filter(F.col("count") <= common), "seldom")
    few = written(values.join(seldom.filter("count > 1").select("value"), "value").select("v", "value"), "few")
    own = seldom.filter("count = 1").select("v").union(few.select("v")).groupBy("v").agg(F.count("*").alias("own"))
    share = 1 - F.coalesce("own", F.lit(0)) / F.least("n", F.lit(WIDE))
    cap = F.when(F.col("n") <= WIDE, F.round(share * F.col("n"))).otherwise(F.least(share + SLACK, F.lit(1.0)) * F.col("n"))
    found = long.join(own, "v", "left").select("v", "n", "often", "wide", cap.alias("cap"), F.floor(F.log("n") / math.log(4 / 3)).alias("bucket"))
    return written(found, "capped"), few


def leader_pairs(now: DataFrame) -> DataFrame:
    """(a, b, sure): in each long list, its texts that may be near a leader b of it: of those of about the same size, the text with the least share of values that aren't common. Texts listed under the same values are one entry of their lists, and lists with the same texts have the same leader."""
    leader = F.struct((-F.col("cap") / F.col("n")).alias("low"), F.xxhash64("v").alias("order"), "v")
    # written: a hot list's entries then meet its leaders in a join that can be split
    entries = written(now.groupBy("often", "bucket").agg(F.min(leader).alias("l")).select("often", "bucket", "l", F.explode("often").alias("value")), "entries")
    leaders = written(entries.groupBy("value", "bucket").agg(F.min("l").alias("leader")), "leaders")
    around = leaders.select("value", "leader", F.explode(F.array(*(F.col("bucket") + k for k in (-1, 0, 1)))).alias("bucket"))
    of = entries.join(around, ["value", "bucket"]).select("often", "bucket", F.col("leader.v").alias("b")).distinct()
    of = of.join(now.select(F.col("v").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y")), "b").withColumnsRenamed({"often": "those", "bucket": "sized"})
    met = now.select(F.col("v").alias("a"), "n", "often", "bucket", F.col("wide").alias("x")).join(of, (F.col("often") == F.col("those")) & (F.col("bucket") == F.col("sized")) & (F.col("a") != F.col("b")) & wide_near("x", "y", "n", "m"))
    return met.select("a", "b", sure()).distinct()


def few_pairs(now: DataFrame, few: DataFrame) -> DataFrame:
    """(a, b, sure): links across components of texts that share a value which is in ``common`` wide sketches at most. Only pairs that can be near with all their common values meet."""
    of = now.select("v", "n", "cap", "component").join(few, "v")
    other = of.withColumnsRenamed({"v": "b", "n": "m", "cap": "cap2", "component": "component2"})
    met = of.withColumnRenamed("v", "a").join(other, "value").filter((F.col("a") < F.col("b")) & (F.col("component") != F.col("component2")) & sizes_near("m", "n"))
    counted = met.groupBy("a", "b", "n", "m", "cap", "cap2").agg(F.count("*").alias("shared"))
    able = (F.greatest("n", "m") > WIDE) | (7 * (F.col("shared") + F.least("cap", "cap2")) >= 3 * (F.col("n") + F.col("m")))
    wide = lambda v, x: now.select(F.col("v").alias(v), F.col("wide").alias(x))
    both = written(counted.filter(able).select("a", "b", "n", "m"), "able").join(wide("a", "x"), "a").join(wide("b", "y"), "b")
    return both.filter(wide_near("x", "y", "n", "m")).select("a", "b", sure())


def labelled(long: DataFrame, labels: DataFrame) -> DataFrame:
    return long.join(labels, "v", "left").withColumn("component", F.coalesce("component", "v"))


def entries_left(now: DataFrame, common: int) -> DataFrame:
    """(v, component, value), written: the entries of the long lists, without texts that are near none of the list by their common values alone. Lists of ``common`` texts at most hold no pair that ``few_pairs`` doesn't meet."""
    of = now.select("v", "n", "cap", "component", F.explode("often").alias("value"))
    lists = of.groupBy("value").agg(F.min("n").alias("low"), F.count("*").alias("texts")).filter(F.col("texts") > common)
    able = 7 * F.col("cap") >= 3 * (F.col("n") + F.greatest(F.col("low"), 0.75 * F.col("n")))
    return written(of.join(lists, "value").filter(able).select("v", "component", "value"), "able")


def largest(entries: DataFrame) -> DataFrame:
    """(value, top, texts, parts): of each list with several components, the largest and the number of texts."""
    sums = entries.groupBy("value", "component").agg(F.count("*").alias("count"))
    return sums.groupBy("value").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("texts"), F.count("*").alias("parts")).filter("parts > 1")


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sorted lists xs shares with each of ys, by products of blocks of columns."""
    held = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    out = np.zeros((len(xs), len(ys)), np.float32)

    def placed(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), [*map(len, lists)])
        place = np.minimum(np.searchsorted(held, flat), len(held) - 1)
        there = held[place] == flat
        return row[there], place[there]

    if len(held):
        sides = placed(xs), placed(ys)
        for at in range(0, len(held), COLUMNS):
            bits = []
            for (row, place), lists in zip(sides, (xs, ys)):
                these = (place >= at) & (place < at + COLUMNS)
                bits.append(np.zeros((len(lists), min(COLUMNS, len(held) - at)), np.float32))
                bits[-1][row[these], place[these] - at] = 1
            out += bits[0] @ bits[1].T
    return out


def met_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
    """(a, b, sure): of two blocks (v, n, component, cap, wide) of one list, links across components: of sure ones those that connect what others don't, of pairs that full sets decide all that these don't connect. Only texts that can be near one of the other block with their common values are compared."""
    (ids, ids2), (n, m), (parts, parts2), (cap, cap2) = (tuple(t.column(c).to_numpy() for t in (left, right)) for c in ("v", "n", "component", "cap"))
    found: list[tuple[int, int, bool]] = []
    able = (parts[:, None] != parts2) & (4 * n[:, None] >= 3 * m) & (4 * m >= 3 * n[:, None]) & (7 * np.minimum(cap[:, None], cap2) >= 3 * (n[:, None] + m))
    rows, cols = np.flatnonzero(able.any(1)), np.flatnonzero(able.any(0))
    if len(rows):
        able, ids, n, parts, ids2, m, parts2 = able[np.ix_(rows, cols)], ids[rows], n[rows], parts[rows], ids2[cols], m[cols], parts2[cols]
        wide, wide2 = ([np.asarray(t.column("wide")[int(k)].values) for k in these] for t, these in ((left, rows), (right, cols)))
        shared = shared_counts(wide, wide2)
        whole = (n[:, None] <= WIDE) & (m <= WIDE)
        near = able & whole & (7 * shared >= 3 * (n[:, None] + m))
        # of sets that aren't whole, WIDE values make the union's sketch
        unsure = able & ~whole & (shared >= WIDE_ESTIMATE * WIDE)
        number = np.unique(np.r_[parts, parts2], return_inverse=True)[1]
        one, two, root = number[: len(ids)], number[len(ids) :], np.arange(number.max() + 1)
        for at in range(len(ids)):
            links = np.flatnonzero(near[at] & (root[two] != root[one[at]]))
            for k in links[np.unique(root[two[links]], return_index=True)[1]]:
                found.append((int(ids[at]), int(ids2[k]), True))
                root[root == root[two[k]]] = root[one[at]]
        for at, k in np.argwhere(unsure):
            if root[two[k]] != root[one[at]] and within_union(wide[at], wide2[k]) >= WIDE_ESTIMATE:
                found.append((int(ids[at]), int(ids2[k]), False))
    return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64()), "sure": pa.array([p[2] for p in found], pa.bool_())})


def within_union(x: np.ndarray, y: np.ndarray) -> float:
    """The likeness of two sets by the sketch of their union."""
    union = np.union1d(x, y)[:WIDE]
    return (np.intersect1d(x, y, assume_unique=True) <= union[-1]).sum() / len(union)


def rest_pairs(now: DataFrame, entries: DataFrame, tops: DataFrame) -> DataFrame:
    """(a, b, sure): links across the components of a long list, as ``met_blocks`` has them: of texts outside the largest component with all others. Each list's texts are dealt to blocks by their hash, and each block of those outside meets each block of the list in a group of its own."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = tops.select("value", F.col("top.component").alias("top"), blocks("texts").alias("all"), F.ceil((F.col("texts") - F.col("top.count")) / BLOCK).cast("int").alias("out"))
    of = entries.join(sizes, "value")
    place = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = of.filter("component != top").select("v", "value", place("out").alias("i"), every("all").alias("j"))
    whole = of.select("v", "value", place("all").alias("j"), every("out").alias("i"))
    wide = now.select("v", "n", "component", "cap", "wide")
    # aliases: the two sides come from the same tables
    groups = [rows.join(wide, "v").select(*(F.col(c).alias(c) for c in ("value", "i", "j", "v", "n", "component", "cap", "wide"))).groupBy("value", "i", "j") for rows in (outside, whole)]
    met = groups[0].cogroup(groups[1]).applyInArrow(met_blocks, "a long, b long, sure boolean")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure").distinct()


def classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, t, n, d1, d2, sketch, row) of each document, written; (v, id, t, row, d1, d2): a number for each set that isn't empty and its least document. t is a hash of the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("t"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(sketched, f"id {kind}, t long, n long, d1 long, d2 long, sketch array<long>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "sketches")
    reps = found.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("id", "t", "row")).alias("least"))
    return found, written(reps.select(F.monotonically_increasing_id().alias("v"), "least.*", "d1", "d2"), "classes")


def texts_of(docs: DataFrame, reps: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(v, text) of the classes needed. Rows equal in id and text are brought together before they move."""
    wanted = written(reps.join(needed, "v").select("v", F.col("id").alias("of"), "t"), "needed")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64(text_or_empty()))
    return written(rows.join(few, (F.col("h") == F.col("t")) & F.col("id").eqNullSafe(F.col("of"))).groupBy("v").agg(F.first("text").alias("text")), "texts")


def links(docs: DataFrame, reps: DataFrame, sketches: DataFrame, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(v, component) over the classes, from sketches (v, n, sketch)."""
    posts = written(listed(sketches, common), "posts")
    pairs = written(estimated(sharing(posts), sketches), "pairs")
    long = posts.filter(F.size("often") > 0)
    texts = texts_of(docs, reps, pairs.select(F.col("a").alias("v")).union(pairs.select("b")).union(long.select("v")).distinct(), id_col, text_col)
    near = written(confirmed(pairs, texts), "links")
    if long.isEmpty():
        return components(near)
    wide = texts.join(long.select("v"), "v", "left_semi").select("v", "text").mapInArrow(widened, "v long, n long, wide array<long>")
    long = written(wide.join(long.select("v", "often"), "v"), "long")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        unsure = written(confirmed(pairs.filter("NOT sure").select("a", "b"), texts), "links")
        return pairs.filter("sure").select("a", "b").union(unsure)

    long, few = capped(long, common)
    near = near.union(linked(leader_pairs(long)))
    now = written(labelled(long, components(near)), "listed")
    near = near.union(linked(few_pairs(now, few)))
    entries = entries_left(now, common)
    tops = written(largest(entries), "largest")
    if not tops.isEmpty():
        near = near.union(linked(rest_pairs(now, entries, tops)))
    return components(near)


def components_of(docs: DataFrame, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, row, n, least): each document with the least one that links reach from it, a struct of id, t and row, written."""
    found, reps = classes(docs, id_col, text_col)
    # three keys, so a hot class isn't one task's
    chosen = found.join(reps.select("v", "d1", "d2", "row"), ["d1", "d2", "row"]).select("v", "n", "sketch")
    parts = written(links(docs, reps, written(chosen, "representatives"), common, id_col, text_col), "components")
    of_class = reps.join(parts, "v", "left").select("d1", "d2", F.coalesce("component", "v").alias("component"), F.struct("id", "t", "row").alias("own"))
    least = written(of_class.groupBy("component").agg(F.min("own").alias("least")), "least")
    of_class = written(of_class.join(least, "component").select("d1", "d2", "least"), "of_class")
    own = F.struct("id", "t", "row")
    return written(found.select("id", "t", "row", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left").select("id", "t", "row", "n", F.coalesce("least", own).alias("least")), "near")


def near_duplicates(docs: DataFrame, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document: the size of its set, the least document that links reach from it, and whether that has its id."""
    rows = components_of(docs, common, id_col, text_col)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), F.col("id").eqNullSafe(F.col("least.id")).alias("kept"))


def one_of_each(docs: DataFrame, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near duplicates: the least id's stays, one row of those equal in id and text. Rows without words stay. How texts meet the list of those that go is left to its size."""
    rows = components_of(docs, common, id_col, text_col)
    # the rows of an id and a text are one class: all of them stay or none does
    keys = rows.groupBy("id", "t").agg(F.max((F.col("n") == 0) | (F.col("least.id").eqNullSafe(F.col("id")) & (F.col("least.t") == F.col("t")))).alias("stays"), F.count("*").alias("copies"), F.max("n").alias("n"))
    of, h, go, repeats = "near_of", "near_text", "near_goes", "near_repeats"
    odd = written(keys.filter("NOT stays OR n > 0 AND copies > 1").select(F.col("id").alias(of), F.col("t").alias(h), (~F.col("stays")).alias(go), F.lit(True).alias(repeats)), "odd")
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("t"))
    marked = packed.join(odd, F.col("id").eqNullSafe(F.col(of)) & (F.col("t") == F.col(h)), "left").filter(F.coalesce(~F.col(go), F.lit(True)))
    single = marked.filter(F.col(repeats).isNull()).select("row.*")
    repeated = marked.filter(F.col(repeats)).groupBy("id", "t").agg(F.first("row").alias("row")).select("row.*")
    return single.union(repeated)
