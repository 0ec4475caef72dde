"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, sources are mixed to target weights, what is left is encoded and decoded.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame with the columns of ``documents`` (the last: tokens).

Cases: null texts count as empty; very long texts are worked on whole. Rows that
share an id, or have none, are documents of their own; of rows equal in id and
text near-dedup keeps one. Of equal least ids in a group the text with the least
hash stays. Columns beyond those of ``documents`` go, whatever their names. An
empty table passes through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, line_dedup, minhash, mixing, toxicity
from tessera.llm.common import shared_folder, text_or_empty, words

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that score as much are rejected.
TOXIC = 0.5


def columns_of(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; further ones go."""
    return docs.select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the learned model scores as toxic."""
    docs = columns_of(docs)
    model = toxicity.learn(docs.select("doc_id", "text"), toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return columns_of(toxicity.score(docs, model, keep=True).filter(F.col("tox_score") < TOXIC))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines found in ten documents or more; the documents stay."""
    kept = line_dedup.dedup(columns_of(docs))
    return columns_of(kept.withColumn("n_chars", F.length(text_or_empty()).cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each group of near duplicates (one row of it), and every document without words."""
    return columns_of(minhash.one_of_each(columns_of(docs)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix takes its words, to the nearest whole, repeats as rows of their own; none: it goes. Texts aren't cut."""
    docs = columns_of(docs)
    size = F.size(words(text_or_empty())).cast("long")
    return columns_of(mixing.spread(docs, size, F.array("source"), mixing.by_order()))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded_sha256): packed token ids of each text, and the digest of the text that they decode to."""
    ids = bpe.encode(columns_of(docs), public_tokenizers.path("byte_bpe_50k.json"), decoded=True, beside=("source",))
    return ids.select("doc_id", "source", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing to target weights", mixed),
    ("BPE encoding", encoded),
]
#: SQL can't express the learned score, the links' components and the merges; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
