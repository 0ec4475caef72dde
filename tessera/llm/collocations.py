"""Phrases of words that stand together more often than their parts would have it, by position bitmaps.

Each task packs the texts of a language into shards of about a million words.
Within a shard every word has a bitmap of its positions; a piece's words follow
each other, and a position that no word has lies between pieces. Bitmaps are
compressed by leaving out their empty bytes: what is kept are (word, cell, byte)
entries, where a cell is eight positions. A phrase grows by a word when its
bitmap of last positions is shifted by one and ANDed with the bitmaps of the words
in the same cells; the popcount of what is left is the longer phrase's count.
Words are taken in chunks, and a chunk's phrases are grown to their full length
before the next chunk's. Popcounts are added up over shards by Spark.

Phrases of three and more words are grown in passes of their own, and only where
the phrases of one word less that begin and end them are frequent over all shards.
What a task knows of these is a table of 2^27 bits set by hashes: a bit set by
chance costs a row that the sum then drops, and none is missed. Its size is fixed,
so with very many frequent phrases it saves less; the result is the same.

Cases: a null or empty text has no words; a null language is ``und`` and joins the
language of that name. Texts are whole; a shard can end at any end of a piece, so
a very long text fills several. A piece isn't cut. Repeated rows count each time.
Ties in rank go to the larger count, then to the lesser phrase by its bytes.
Columns besides the text and the language don't matter. An empty table gives no
rows. Counts over 10^15 are refused with an overflow error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, text_or_empty, written

#: A piece ends at each of these.
ENDS = ".,;:!?\n\x0b\x0c\r"
#: In bytes: letters in lower case, ends as line ends, tabs as spaces.
FOLD = bytes.maketrans((UPPER + ENDS + "\t").encode(), (LOWER + "\n" * len(ENDS) + " ").encode())
#: Bytes of text in a shard, and held by a task over all languages.
SHARD, HELD = 6 << 20, 24 << 20
#: Entries that are extended at once.
CHUNK = 1 << 16
#: The table of frequent phrases has 2 to the power of so many bits.
BITS = 27
#: Parts that the ranking of a language is dealt to before its best are ranked together.
PARTS = 64
COUNTS = "lang string, phrase string, f long"
POPCOUNT = np.array([bin(k).count("1") for k in range(256)], np.int64)
MASK64 = (1 << 64) - 1
#: Odd factors of the hash that joins the hashes of words.
FACTORS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def seed_of(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def joined_hash(h, x):
    """The hash of a phrase of hash h with a word of hash x behind it, of numbers below 2^64 or arrays of them."""
    if isinstance(h, int):
        h = ((h * FACTORS[0] & MASK64) + x & MASK64) * FACTORS[1] & MASK64
        return h ^ (h >> 29)
    h = (h * np.uint64(FACTORS[0]) + x) * np.uint64(FACTORS[1])
    return h ^ (h >> np.uint64(29))


def is_set(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (table[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)


def bit_of(h):
    """The bit of a hash in the table."""
    return h >> (64 - BITS) if isinstance(h, int) else (h >> np.uint64(64 - BITS)).astype(np.int64)


class Vertical:
    """A shard's bitmaps: entries (word, cell, byte) by word, and by cell."""

    def __init__(self, data: bytes) -> None:
        tokens = pc.split_pattern(pa.array([data.replace(b"\n", b" \n ")], pa.large_binary()), pattern=" ").flatten().dictionary_encode()
        self.words = tokens.dictionary.cast(pa.binary()).cast(pa.string())
        ids = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = self.words.to_pylist()
        if "" in known:
            ids = ids[ids != known.index("")]
        position = np.arange(len(ids))
        if "\n" in known:
            inside = ids != known.index("\n")
            ids, position = ids[inside], position[inside]
        self.n = len(ids)
        order = np.argsort(ids, kind="stable")
        word, cell = ids[order], position[order] >> 3
        starts = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (cell[1:] != cell[:-1])]) if self.n else np.array([], np.int64)
        self.word, self.cell = word[starts], cell[starts]
        self.byte = np.bitwise_or.reduceat((1 << (position[order] & 7)).astype(np.uint8), starts) if self.n else np.array([], np.uint8)
        by_cell = np.argsort(self.cell, kind="stable")
        self.cell_word, self.cell_byte = self.word[by_cell], self.byte[by_cell]
        # two cells more: a bitmap's last bit can be shifted out of its last cell
        self.count = np.bincount(self.cell, minlength=(int(self.cell.max()) if self.n else 0) + 3)
        self.start = np.cumsum(self.count) - self.count

    def grown(self, of: np.ndarray, cell: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shift and AND: (of, word, cell, byte) of the entries' phrases, each with a word more."""
        wide = byte.astype(np.uint16) << 1
        stays, goes = wide & 255, wide >> 8
        a, b = stays > 0, goes > 0
        of, cell, byte = np.r_[of[a], of[b]], np.r_[cell[a], cell[b] + 1], np.r_[stays[a], goes[b]].astype(np.uint8)
        n = self.count[cell]
        at = np.repeat(self.start[cell] - np.cumsum(n) + n, n) + np.arange(n.sum())
        entry = np.repeat(np.arange(len(of)), n)
        both = byte[entry] & self.cell_byte[at]
        hit = np.flatnonzero(both)
        entry = entry[hit]
        return of[entry], self.cell_word[at[hit]], cell[entry], both[hit]


def grouped(of: np.ndarray, word: np.ndarray, cell: np.ndarray, byte: np.ndarray, n_words: int):
    """Entries by phrase: the phrases (of, word), their popcounts, and the entries with the numbers of their phrases."""
    key = of * n_words + word
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.array([], bool)
    starts = np.flatnonzero(new)
    counts = np.add.reduceat(POPCOUNT[byte[order]], starts) if len(key) else np.array([], np.int64)
    return (of[order][starts], word[order][starts]), counts, (np.cumsum(new) - 1, cell[order], byte[order])


def batch_of(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(phrases)), phrases, pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])


def counted(lang: str, data: bytes, length: int, tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A shard's counts: of the empty phrase (all words), of words and of pairs for length 2, else of phrases of ``length`` words. tables: bits of the frequent phrases of 2 to length - 1 words."""
    v = Vertical(data)
    if not v.n:
        return
    if length == 2:
        per_word = np.bincount(v.word, weights=POPCOUNT[v.byte], minlength=len(v.words)).astype(np.int64)
        there = np.flatnonzero(per_word)
        yield batch_of(lang, pa.concat_arrays([pa.array([""]), v.words.take(pa.array(there))]), np.r_[v.n, per_word[there]])
    else:
        seed = seed_of(lang)
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in v.words.to_pylist()], np.uint64)
    for a in range(0, len(v.word), CHUNK):
        entries = slice(a, a + CHUNK)
        phrase = [v.word[entries]]  # of each number of a phrase: its words
        of, cell, byte = np.arange(len(phrase[0])), v.cell[entries], v.byte[entries]
        # entries of one word that follow each other are one phrase
        number = np.cumsum(np.r_[False, phrase[0][1:] != phrase[0][:-1]])
        phrase, of = [phrase[0][np.r_[True, phrase[0][1:] != phrase[0][:-1]]]], number
        for k in range(2, length + 1):
            (before, word), counts, (of, cell, byte) = grouped(*v.grown(of, cell, byte), len(v.words))
            phrase = [*(w[before] for w in phrase), word]
            if length > 2:
                # the whole phrase, or what it ends with if it has its full length
                tail = phrase if k < length else phrase[1:]
                h = hashes[tail[0]]
                for w in tail[1:]:
                    h = joined_hash(h, hashes[w])
                keep = is_set(tables[len(tail)], bit_of(h)) if len(tail) > 1 else np.ones(len(word), bool)
                number = np.cumsum(keep) - 1
                phrase, counts = [w[keep] for w in phrase], counts[keep]
                stays = keep[of]
                of, cell, byte = number[of[stays]], cell[stays], byte[stays]
        if len(counts):
            yield batch_of(lang, pc.binary_join_element_wise(*(v.words.take(pa.array(w)) for w in phrase), " "), counts)


def counter(length: int, bits: dict[int, bytes]):
    """Packs (lang, text) into shards and counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.frombuffer(b, np.uint8) for k, b in bits.items()}
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flushed(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            return counted(lang, b"\n".join(held.pop(lang)), length, tables)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                data, at = text.as_py().translate(FOLD), 0
                while at < len(data):
                    end = len(data)
                    if end - at > SHARD:
                        cut = data.rfind(b"\n", at, at + SHARD)
                        cut = data.find(b"\n", at + SHARD) if cut < 0 else cut
                        end = len(data) if cut < 0 else cut + 1
                    held.setdefault(lang, []).append(data[at:end])
                    sizes[lang] = sizes.get(lang, 0) + end - at
                    at = end
                    if sizes[lang] >= SHARD:
                        yield from flushed(lang)
                if sum(sizes.values()) >= HELD:
                    yield from flushed(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from flushed(lang)

    return run


def counts_of(texts: DataFrame, length: int, bits: dict[int, bytes], least: int) -> DataFrame:
    """(lang, phrase, f) of what a pass counts, if frequent. A shard has each phrase once, so nothing is gained by adding up before the shuffle, and no phrase has more rows than there are shards."""
    rows = texts.mapInArrow(counter(length, bits), COUNTS).repartition("lang", "phrase")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def table_of(frequent: DataFrame) -> bytes:
    """The bits of frequent phrases: 2^27 of them, however many phrases there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, int] = {}
        for batch in batches:
            found = []
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns)):
                seed = seeds.setdefault(lang, seed_of(lang))
                first, *rest = (xxhash.xxh64_intdigest(w, seed) for w in phrase.split(" "))
                for x in rest:
                    first = joined_hash(first, x)
                found.append(bit_of(first))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["bit"])

    wide = 1 << 15  # bits in a bitmap of Spark's
    bits = frequent.select("lang", "phrase").mapInArrow(run, "bit long")
    packed = bits.groupBy(F.floor(F.col("bit") / wide).alias("block")).agg(F.bitmap_construct_agg(F.col("bit") % wide).alias("bits"))
    out = bytearray((1 << BITS) // 8)
    for r in packed.collect():  # 4,096 rows of 4 KB at most
        out[r.block * wide // 8 : (r.block + 1) * wide // 8] = r.bits
    return bytes(out)


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3, text_col: str = "text", lang_col: str = "lang") -> list[DataFrame]:
    """(lang, phrase, f) of what occurs ``least`` times or more: first words, pairs and, as the empty phrase, all words; then phrases of 3, of 4 words and so on."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    found, bits = [written(counts_of(texts, 2, {}, least), "phrases")], {}
    for length in range(3, longest + 1):
        shorter = found[-1].filter(words_in("phrase") == 2) if length == 3 else found[-1]
        bits = bits | {length - 1: table_of(shorter)}
        found.append(written(counts_of(texts, length, bits, least), "phrases"))
    return found


def words_in(phrase: str):
    return F.when(F.col(phrase) == "", 0).otherwise(F.size(F.split(phrase, " ")))


def part(first, n):
    return F.array_join(F.slice("words", first, n), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two and more words, by the cut that scores lowest; equal ones: after the fewest words. Products are decimals of 38 digits."""
    phrases = frequent.filter(words_in("phrase") >= 2).select("lang", "phrase", F.split("phrase", " ").alias("words"), F.col("f").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.size("words") - F.col("k"))})
    of = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    whole = lambda c: f"CAST({c} AS decimal(15,0))"
    score = F.expr(f"(CAST(1000000 AS decimal(7,0)) * ({whole('a')} * {whole('a')})) DIV ({whole('l')} * {whole('r')})")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", F.split("phrase", " ").alias("words"), "a", "cut.l", "cut.r", "cut.score")


def without_parts(candidates: DataFrame, share: int = 50) -> DataFrame:
    """Drops what stands inside a longer candidate, kept or not, that has ``share`` % of its occurrences or more."""
    longer = candidates.filter(F.size("words") > 2).select("lang", "words", "a")
    sizes = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.size("words") - 1)))
    places = sizes.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)))
    inside = places.select("lang", part(F.col("at"), F.col("n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    return candidates.join(inside, ["lang", "phrase"], "left").filter(F.col("outer").isNull() | (100 * F.col("outer") < share * F.col("a"))).drop("outer")


def best(candidates: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first. A language is ranked in parts first, so that one task meets ``top`` rows of each part at most."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    few = ranked(candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part").drop("rank", "part")
    return ranked(few, "lang").join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, share: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's best collocations of two to ``longest`` words."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    tables = frequent_phrases(docs, least, longest, text_col, lang_col)
    frequent = tables[0]
    for t in tables[1:]:
        frequent = frequent.unionByName(t)
    totals = tables[0].filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return best(without_parts(scored(frequent.filter("phrase <> ''")), share), totals, top)
