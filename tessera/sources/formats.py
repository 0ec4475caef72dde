"""Round trips through the file formats, partitioned and bucketed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.parts import Parts
from tessera.sources.tables import table
from tessera.streaming.events import scratch

#: Options of readers and writers that keep every value.
OPTIONS = {"csv": {"header": "true"}, "xml": {"rowTag": "row"}}


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """The rows as read from files of the format, under their own schema."""
    folder, options = scratch(df.sparkSession, kind), OPTIONS.get(kind, {})
    df.write.format(kind).options(**options).save(folder)
    return df.sparkSession.read.format(kind).options(**options).schema(df.schema).load(folder).select(*df.columns)


def through(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_trip(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), kind)

    return run


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), "text")


def pruned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in a folder for each status; only one is read again."""
    folder = scratch(spark, "partitioned")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    orders.write.partitionBy("o_orderstatus").parquet(folder)
    return spark.read.schema(orders.schema).parquet(folder).filter("o_orderstatus = 'P'").select(*orders.columns)


def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines bucketed on their key, joined where they lie."""
    name, n = uuid.uuid4().hex, int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    for df, kind in ((orders, "orders"), (lines, "lines")):
        df.write.bucketBy(n, "k").sortBy("k").saveAsTable(f"{kind}_{name}")
    joined = spark.table(f"orders_{name}").hint("merge").join(spark.table(f"lines_{name}"), "k")
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as rows: bytes of the customers' names, a line each."""
    folder = scratch(spark, "binary")
    table(spark, sf_dir, "customer").select("c_name").write.text(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.agg(F.sum(F.length("content")).alias("bytes"))


def python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written to and read from a format of our own; the filters are pushed to its reader."""
    folder = scratch(spark, "parts")
    spark.dataSource.register(Parts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"))
    customers.write.format("tessera_parts").mode("append").option("path", folder).option("group_rows", 1000).save()
    return spark.read.format("tessera_parts").option("path", folder).load().filter("c_acctbal > 5000 AND segment IN ('FURNITURE', 'MACHINERY') AND c_name LIKE '%1'")


_customers = "SELECT c_custkey, c_name, c_acctbal FROM customer"
QUERIES = {f"format_{k}": through(k) for k in ("parquet", "orc", "json", "csv", "xml")} | {"format_text": text_lines, "partition_pruning": pruned_partitions, "bucketed_join": bucketed_join, "binary_files": binary_files, "python_source": python_source}
ORACLES = {f"format_{k}": _customers for k in ("parquet", "orc", "json", "csv", "xml")} | {
    "binary_files": "SELECT sum(strlen(c_name) + 1)::bigint AS bytes FROM customer",
    "python_source": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment AS segment FROM customer WHERE c_acctbal > 5000 AND c_mktsegment IN ('FURNITURE', 'MACHINERY') AND c_name LIKE '%1'",
    "format_text": "SELECT c_name AS value FROM customer",
    "partition_pruning": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'",
    "bucketed_join": "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
}
