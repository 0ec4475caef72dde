"""SimHash fingerprints of whole texts, and search within a Hamming radius.

Terms are words; each votes with a weight that grows with its length on the
signed bits of its 128-bit hash. Votes are plain sums in generated code: shifting
a hash by b and masking leaves bits b and b + 32 in two lanes of one long, so 32
sums hold the votes for 64 bits (a lane takes 2^32 / 15 terms of one text). The
sums of a text are made where its row is, without a shuffle of terms.

The search puts fingerprints into tables by pairs of blocks: 128 bits in
radius + 2 blocks, of which at least two agree between any two fingerprints
within the radius, so each pair of blocks is the key of one table. The query searches all
fingerprints of whole documents: ``n_within`` other fingerprints lie within RADIUS
bits of a document's own, the ``nearest`` at that many bits. Links aren't capped:
work grows with the pairs that share a key; they are counted in arrays of a key's
fingerprints, so no row is made for a link. ``within`` gives the links themselves.

Cases: a null text is empty; a text without words has the fingerprint of zeros.
Equal texts have equal fingerprints. Documents that share an id share their next
document, the row of the next id whose text has the least hash; its text is copied
from and its fingerprint is compared. A single document is its own next. Bits whose votes
are even are 0. Very long texts vote whole, up to 2^28 terms. Ids are whole
numbers; a null id, as the least 64-bit number stands for it, comes before all
others. Only the id and text columns are read, whatever the names of others; an
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, SPACE_CLASS, SPACES, UPPER, checkpointed, text_or_empty, written

BITS = 128
#: Stands for a null id, which comes before all others: joins on plain equality keep the partitions they were dealt to.
NO_ID = -(1 << 63)
LANES = 0x0000000100000001
HEAVIEST = 16
#: Bits in which fingerprints that the search finds may differ: the most whose keys (two of eight blocks) still have 32 bits.
RADIUS = 6
#: Fingerprints under one key of a block table that one part of the join takes.
CROWD = 1024
#: Parts that the rows of a hot fingerprint are dealt to.
SHARES = 64


def terms(text: Column) -> Column:
    """The words of a text, A-Z in lower case; one empty term if there are none."""
    return F.split(F.translate(F.trim(text, F.lit(SPACES)), UPPER, LOWER), SPACE_CLASS)


def weight(term: Column) -> Column:
    size = F.length(term)
    return F.when(size == 0, 0).otherwise(F.greatest(F.least(size, F.lit(HEAVIEST)) - 1, F.lit(1))).cast("long")


def hashes(term: Column) -> list[Column]:
    return [F.xxhash64(term), F.xxhash64(F.lit(1), term)]


def votes(hashed: str, k: int) -> list[Column]:
    """The 32 sums that hold the votes of one 64-bit hash."""
    return [F.sum(F.shiftrightunsigned(hashed, b).bitwiseAND(F.lit(LANES)) * F.col("weight")).alias(f"v{k}_{b}") for b in range(32)]


def signed_bits(k: int) -> Column:
    """The 64 bits whose votes outweigh half of all."""
    lane = lambda b: F.col(f"v{k}_{b}").bitwiseAND(F.lit(0xFFFFFFFF)) if b < 32 else F.shiftrightunsigned(f"v{k}_{b - 32}", 32)
    one = lambda b: F.when(2 * lane(b) > F.col("total"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(0)
    return reduce(lambda a, b: a.bitwiseOR(b), (one(b).cast("long") for b in range(64)))


def fingerprint(rows: DataFrame, keys: list[str], term_col: str) -> DataFrame:
    """(keys, f1, f2): the two halves of the fingerprint of each group's terms."""
    hashed = rows.select(*keys, weight(F.col(term_col)).alias("weight"), *(h.alias(f"h{k}") for k, h in enumerate(hashes(F.col(term_col)))))
    sums = hashed.groupBy(*keys).agg(F.sum("weight").alias("total"), *votes("h0", 0), *votes("h1", 1))
    return sums.select(*keys, signed_bits(0).alias("f1"), signed_bits(1).alias("f2"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f1, f2) of each document's whole text."""
    rows = docs.select(id_col, F.monotonically_increasing_id().alias("row"), terms(text_or_empty(text_col)).alias("terms"))
    return fingerprint(rows.select(id_col, "row", F.explode("terms").alias("term")), [id_col, "row"], "term").drop("row")


def unbroadcast(df: DataFrame) -> DataFrame:
    """The rows, whose next join shuffles both sides: Spark sizes tables without the rows that an explode adds and by how files compress them, keeps to a broadcast chosen so, and can send the driver many times the limit."""
    return df.hint("merge")


def next_ids(docs: DataFrame, id_col: str, half: Column) -> DataFrame:
    """(id, next_id, need) for each id: the id after it (after the last: the first) and the most code points that its edited texts want. Ids alone are ordered, by range; the last of each range takes the first of the following one."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.max(half).alias("need"))
    ranged = checkpointed(ids.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()))
    inner = ranged.withColumn("next_id", F.lead("id").over(Window.partitionBy("part").orderBy("id"))).withColumn("is_last", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("id"))) == 1)
    # a row for each range: their number is that of the partitions
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first"))
    ends = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("following"), F.first("first").over(Window.orderBy("part")).alias("very_first"))
    return inner.join(F.broadcast(ends), "part").select("id", F.when(F.col("is_last"), F.coalesce("following", "very_first")).otherwise(F.col("next_id")).alias("next_id"), "need")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, next_id, text, hash, edited): the edited text has the first code points of the next document in place of the last half. Of the next text only the code points needed are shuffled."""
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_or_empty(text_col).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    after = next_ids(own, "id", half)
    provider = own.select(F.col("id").alias("next_id"), "text")
    given = unbroadcast(after).join(provider, after["next_id"] == provider["next_id"]).select("id", after["next_id"], F.xxhash64("text").alias("hash"), F.substring("text", F.lit(1), F.col("need")).alias("prefix"))
    given = given.groupBy("id", "next_id").agg(F.min(F.struct("hash", "prefix")).alias("least")).select(F.col("id").alias("of"), "next_id", "least.prefix")
    both = unbroadcast(own).join(given, own["id"] == given["of"])
    changed = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("prefix", F.lit(1), half))
    return both.select(F.col("id").alias(id_col), "next_id", "text", F.xxhash64("text").alias("hash"), changed.alias("edited"))


def differing(a: list[Column], b: list[Column]) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))


def likeness(a: list[Column], b: list[Column]) -> Column:
    return 1.0 - differing(a, b) / F.lit(float(BITS))


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, next_id, hash, n_chars, edited_sha256, f1, f2, e1, e2): fingerprints of every document and of its edited text, written in the shared folder."""
    pairs = edited(docs, id_col, text_col)
    rows = pairs.select(
        F.col(id_col).alias("doc_id"),
        "next_id",
        "hash",
        F.monotonically_increasing_id().alias("row"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"))).alias("sides"),
    )
    keys = ["doc_id", "next_id", "hash", "row", "n_chars", "edited_sha256"]
    # each step apart: what stands beside an explode is computed for every row that it makes
    sides = rows.select(*keys, F.explode("sides").alias("side")).select(*keys, F.col("side.which").alias("which"), terms(F.col("side.text")).alias("terms"))
    exploded = sides.select(*keys, "which", F.explode("terms").alias("term"))
    found = fingerprint(exploded, [*keys, "which"], "term")
    side = lambda k, f: F.max(F.when(F.col("which") == k, F.col(f)))
    return written(found.groupBy(*keys).agg(side(0, "f1").alias("f1"), side(0, "f2").alias("f2"), side(1, "f1").alias("e1"), side(1, "f2").alias("e2")).drop("row"), "fingerprints")


def as_hex(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def compare(found: DataFrame) -> DataFrame:
    """Likeness of each document's fingerprint to that of its edited text and of the next document, and what the search finds: n_within and nearest."""
    following = found.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("hash", "f1", "f2")).alias("n"))
    both = with_neighbours(found).join(unbroadcast(following), F.col("next_id") == F.col("id"))
    mine = [F.col("f1"), F.col("f2")]
    return both.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_hex("f1", "f2").alias("fingerprint"),
        as_hex("e1", "e2").alias("edited_fingerprint"),
        likeness(mine, [F.col("e1"), F.col("e2")]).alias("near_edited"),
        likeness(mine, [F.col("n.f1"), F.col("n.f2")]).alias("near_next"),
        "n_within",
        "nearest",
    )


def block_masks(radius: int) -> list[tuple[int, int]]:
    """For each of radius + 2 blocks of all bits, its bits in the two halves, as signed longs."""
    n = radius + 2
    ends = [BITS * k // n for k in range(n + 1)]
    ones = [(1 << BITS - a) - (1 << BITS - b) for a, b in zip(ends, ends[1:])]
    signed = lambda x: x - (1 << 64) * (x >> 63)
    return [(signed(m >> 64), signed(m & (1 << 64) - 1)) for m in ones]


def keyed(few: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(blocks, key, f1, f2): each fingerprint under its key in every table, a hash of the bits of the table's two blocks; ``blocks`` has a bit set for each of the two."""
    key = lambda a, b: F.xxhash64(F.lit(1 << a | 1 << b), *(F.col(f"f{h + 1}").bitwiseAND(F.lit(masks[a][h] | masks[b][h]).cast("long")) for h in (0, 1)))
    tables = [F.struct(F.lit(1 << a | 1 << b).alias("blocks"), key(a, b).alias("key")) for a, b in combinations(range(len(masks)), 2)]
    return few.select("f1", "f2", F.explode(F.array(*tables)).alias("t")).select("t.blocks", "t.key", "f1", "f2")


def first_met(masks: list[tuple[int, int]], g1: Column, g2: Column) -> Column:
    """Whether the two blocks of the row's table are the first two on which f and g agree: of all tables in which a pair meets, one alone counts it."""
    same = lambda a, b: (F.col("f1").bitwiseXOR(g1).bitwiseAND(F.lit(a).cast("long")) == 0) & (F.col("f2").bitwiseXOR(g2).bitwiseAND(F.lit(b).cast("long")) == 0)
    agree = reduce(lambda x, y: x + y, (F.when(same(a, b), 1 << k).otherwise(0) for k, (a, b) in enumerate(masks)))
    return agree.bitwiseAND(F.col("upto")) == F.col("blocks")


def met_in_tables(found: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(blocks, upto, key, f1, f2, parts), written: the entries of all tables but those of keys that one fingerprint alone has. upto has the bits of all blocks up to the second of the two; the fingerprints of a key are dealt to parts of about CROWD. Copies count as one fingerprint."""
    entries = keyed(found.select("f1", "f2").distinct(), masks)
    crowded = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    upto = 2 * (F.col("blocks") - F.col("blocks").bitwiseAND(-F.col("blocks"))) - 1
    return written(unbroadcast(entries).join(crowded, "key").select("blocks", upto.alias("upto"), "key", "f1", "f2", F.ceil(F.col("n") / CROWD).alias("parts")), "tables")


def in_part() -> Column:
    return F.pmod(F.xxhash64("f1", "f2"), "parts").alias("part")


def every_part() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))


def within(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f1, f2, g1, g2, distance): all pairs of different fingerprints (the first the lesser) within the radius, each once. Distances are tested within the join, which makes rows of links alone."""
    masks = block_masks(radius)
    met = met_in_tables(found, masks)
    left = met.select("blocks", "upto", "key", "f1", "f2", in_part())
    right = met.select(F.col("key").alias("other_key"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), every_part().alias("other_part"))
    distance = differing([F.col("f1"), F.col("f2")], [F.col("g1"), F.col("g2")])
    lesser = (F.col("f1") < F.col("g1")) | ((F.col("f1") == F.col("g1")) & (F.col("f2") < F.col("g2")))
    near = unbroadcast(left).join(right, (F.col("key") == F.col("other_key")) & (F.col("part") == F.col("other_part")) & lesser & (distance <= radius) & first_met(masks, F.col("g1"), F.col("g2")))
    return near.select("f1", "f2", "g1", "g2", distance.cast("int").alias("distance"))


def neighbours(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f1, f2, n_within, nearest): of each fingerprint that has any, how many other fingerprints lie within the radius, and the least distance. Each entry of a table meets the parts of its key as arrays and counts in them, so rows grow with the entries (times the parts of keys of more than CROWD) and not with the links."""
    masks = block_masks(radius)
    met = met_in_tables(found, masks)
    parts = met.groupBy(F.col("key").alias("other_key"), in_part().alias("other_part")).agg(F.collect_list(F.struct(F.col("f1").alias("g1"), F.col("f2").alias("g2"))).alias("others"))
    entries = met.select("blocks", "upto", "key", "f1", "f2", every_part().alias("part"))
    both = unbroadcast(entries).join(parts, (F.col("key") == F.col("other_key")) & (F.col("part") == F.col("other_part")))
    away = lambda g: differing([F.col("f1"), F.col("f2")], [g["g1"], g["g2"]])
    near = F.filter("others", lambda g: away(g).between(1, radius) & first_met(masks, g["g1"], g["g2"]))
    counted = both.select("f1", "f2", F.transform(near, away).alias("distances")).select("f1", "f2", F.size("distances").alias("n"), F.array_min("distances").alias("nearest"))
    return counted.filter("n > 0").groupBy("f1", "f2").agg(F.sum("n").alias("n_within"), F.min("nearest").cast("int").alias("nearest"))


def hot_fingerprints(found: DataFrame) -> DataFrame:
    """(h1, h2, shares) of the fingerprints that more than CROWD rows and more than one in CROWD of all rows have: fewer than CROWD of them, however long the table."""
    most = max(CROWD, found.count() // CROWD)
    many = found.groupBy("f1", "f2").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return many.select(F.col("f1").alias("h1"), F.col("f2").alias("h2"), F.lit(SHARES).alias("shares"))


def with_neighbours(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``found`` with n_within (0 if there are none) and nearest (null). Rows of a hot fingerprint, of which copies make many, are dealt to SHARES tasks."""
    hot = F.broadcast(written(hot_fingerprints(found), "hot"))
    is_hot = (F.col("f1") == F.col("h1")) & (F.col("f2") == F.col("h2"))
    shares = F.coalesce("shares", F.lit(1))
    near = neighbours(found, radius).join(hot, is_hot, "left").select(F.col("f1").alias("n1"), F.col("f2").alias("n2"), "n_within", "nearest", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    dealt = found.join(hot, is_hot, "left").withColumn("dealt", F.pmod(F.xxhash64("doc_id"), shares).cast("int"))
    both = dealt.join(near, (F.col("f1") == F.col("n1")) & (F.col("f2") == F.col("n2")) & (F.col("dealt") == F.col("share")), "left")
    return both.select(*found.columns, F.coalesce("n_within", F.lit(0)).cast("long").alias("n_within"), "nearest")
