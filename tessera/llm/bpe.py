"""BPE encoding and decoding of whole texts with a byte-level vocabulary.

A pre-token's merges run on contiguous arrays: the ids of its parts and the rank
of each adjacent pair. The least rank is looked for again and again, its boundary
deleted and the two neighbouring ranks refreshed. Pre-tokens of more than
``LONG`` bytes take the same merges from a heap, as scanning would be quadratic.

Cases: a null text is empty; an empty text has no ids and decodes to "". The
text of an added token (such as an end-of-text mark) is one id wherever it
stands. Of equal least ranks the leftmost merges first. A text is encoded whole,
however long; a worker holds one text's ids at a time beside its batch. Ids of
documents are of any type; repeated ids are separate rows. Only the id and text
columns are read, so further columns, whatever their names, don't matter. A
tokenizer file that asks for more than plain byte-level BPE is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of byte-level BPE: contractions, then runs of letters, of numbers, of other signs, of spaces.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 60
LONG = 256
#: Pre-tokens of up to LONG bytes that a worker remembers; others are encoded anew each time.
REMEMBERED = 400_000
ROWS = 256


def byte_signs() -> list[str]:
    """The printable sign by which vocabulary files write each byte: itself if printable in Latin-1, else the next code point from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class UnsupportedTokenizer(ValueError):
    """The tokenizer file asks for steps that aren't followed here."""


def check(spec: dict) -> None:
    """Refuses files whose ids would come out wrong: other models, normalizers, ways to split, merges that are passed over, added tokens that take spaces or whole words."""
    model, split, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    wrong = [
        *(k for k in ("normalizer", "truncation", "padding") if spec.get(k)),
        *(k for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)),
        *(["model"] if model.get("type", "BPE") != "BPE" else []),
        *(["pre_tokenizer"] if split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True) else []),
        *(["decoder"] if decoder.get("type") != "ByteLevel" else []),
        *(f"added token {t['content']!r}" for t in spec["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")),
    ]
    if wrong:
        raise UnsupportedTokenizer(f"not a plain byte-level BPE: {', '.join(wrong)}")


def read_vocabulary(path: str) -> dict:
    """Merges, ids and added tokens of a tokenizer file, as plain values (their number is the vocabulary's, whatever the corpus)."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    check(spec)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return {"merges": merges, "ids": spec["model"]["vocab"], "added": {t["content"]: t["id"] for t in spec["added_tokens"]}}


class Codec(dict):
    """Pre-token to packed ids (little-endian, 32 bits each)."""

    def __init__(self, vocabulary: dict) -> None:
        super().__init__()
        signs, ids = byte_signs(), vocabulary["ids"]
        of_sign = {s: b for b, s in enumerate(signs)}
        self.first = [ids[s] for s in signs]
        self.bytes = {i: bytes(of_sign[c] for c in t) for t, i in ids.items()}
        self.bytes |= {i: t.encode() for t, i in vocabulary["added"].items()}
        self.rank = {(ids[a] << 32) | ids[b]: r for r, (a, b) in enumerate(vocabulary["merges"])}
        self.merged = [ids[a + b] for a, b in vocabulary["merges"]]
        self.added = vocabulary["added"]
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pre_tokens = regex.compile(PRE_TOKEN).findall

    def __missing__(self, token: str) -> bytes:
        parts = [self.first[b] for b in token.encode()]
        if len(parts) > LONG:  # not remembered: what is has a bound in bytes
            return pack(self.merge_long(parts))
        packed = pack(self.merge(parts))
        if len(self) < REMEMBERED:
            self[token] = packed
        return packed

    def merge(self, parts: list[int]) -> list[int]:
        rank, merged = self.rank.get, self.merged
        ranks = [rank((a << 32) | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1] << 32) | parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank((parts[i] << 32) | parts[i + 1], NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        rank, n = self.rank.get, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i] << 32) | parts[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue  # one of the two has merged since
            parts[i], parts[j], after[i] = self.merged[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank((parts[a] << 32) | parts[b], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        if self.marks is None or not (found := [*self.marks.finditer(text)]):
            return b"".join(map(self.__getitem__, self.pre_tokens(text)))
        out, at = [], 0
        for mark in found:
            out += [*map(self.__getitem__, self.pre_tokens(text[at : mark.start()])), pack([self.added[mark[0]]])]
            at = mark.end()
        return b"".join([*out, *map(self.__getitem__, self.pre_tokens(text[at:]))])

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, unpack(packed))).decode("utf-8", "replace")


def pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpack(packed: bytes) -> array:
    out = array("I", packed)
    if sys.byteorder == "big":
        out.byteswap()
    return out


_codecs: dict[str, Codec] = {}


def codec_of(shared) -> Codec:
    """A worker builds the tables of a broadcast vocabulary once."""
    if shared.value["key"] not in _codecs:
        _codecs.clear()  # a worker holds one
        _codecs[shared.value["key"]] = Codec(shared.value)
    return _codecs[shared.value["key"]]


def _broadcast(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:  # by content: a worker outlives a file
        key = hashlib.sha256(f.read()).hexdigest()
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary) | {"key": key})


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, beside: tuple = ()) -> DataFrame:
    """(id, ids binary[, decoded string], columns named in ``beside``): the ids of each whole text, packed as little-endian unsigned 32-bit integers, and with ``decoded`` the text that they decode to. No shuffle: each task streams its rows through the merges. ``vocabulary`` is the tokenizer file's path, read on the driver alone."""
    shared = _broadcast(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                ids = [codec.encode(t or "") for t in rows.column(1).to_pylist()]
                out = [rows.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    out.append(pa.array(map(codec.decode, ids), pa.string()))
                out += rows.columns[2:]
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = [id_col, "ids", *(["decoded"] if decoded else []), *beside]
    kinds = [docs.schema[id_col].dataType.simpleString(), "binary", *(["string"] if decoded else []), *(docs.schema[n].dataType.simpleString() for n in beside)]
    return docs.select(id_col, text_col, *beside).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the text of packed ids; null ids decode to "". Bytes that are no UTF-8 become U+FFFD."""
    shared = _broadcast(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([codec.decode(x or b"") for x in rows.column(1).to_pylist()], pa.string())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Count of tokens and SHA-256 of ids and decoded text, for each row of ``encode(..., decoded=True)``."""
    return encoded.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
