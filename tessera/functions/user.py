"""The surfaces for functions of one's own: over Arrow batches, groups, pairs of groups, windows and tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tessera.sources.tables import table


@F.pandas_udf(DoubleType())
def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
    return (price * (1 - discount)).round(4)


@F.pandas_udf(DoubleType())
def spread(x: pd.Series) -> float:
    return float(x.max() - x.min())


def pandas_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", discounted("l_extendedprice", "l_discount").alias("net"))


def pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(spread("o_totalprice").alias("spread"))


def pandas_over_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Window.partitionBy("o_custkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "orders").select("o_orderkey", spread("o_totalprice").over(whole).alias("spread"))


def arrow_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths], names=["p_partkey", "n"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_name").mapInArrow(run, "p_partkey long, n long")


@F.udf(returnType=StringType())
def initials(name: str) -> str:
    return "".join(w[0] for w in name.split(" "))


def plain_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row by row: the slow path, for what no built-in function says."""
    return table(spark, sf_dir, "part").select("p_partkey", initials("p_name").alias("initials"))


@F.arrow_udf(DoubleType())
def doubled(x: pa.Array) -> pa.Array:
    return pc.multiply(x, 2.0)


def arrow_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", doubled("p_retailprice").alias("twice"))


def pandas_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[rows["p_size"] > 25]

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, p_size int")


def grouped_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each supplier, counted by task and supplier first, so that no group is larger than the number of tasks."""

    def total(rows: pa.Table) -> pa.Table:
        return pa.table({"l_suppkey": rows.column("l_suppkey").slice(0, 1), "n": pa.array([pc.sum(rows.column("n")).as_py()], pa.int64())})

    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    return counts.groupBy("l_suppkey").applyInArrow(total, "l_suppkey long, n long")


def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since the user's event before."""

    def gaps(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        return pd.DataFrame({"event_id": rows["event_id"], "gap": rows["ts"].diff().dt.total_seconds().fillna(-1).round(3)})

    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts").groupBy("user_id").applyInPandas(gaps, "event_id long, gap double")


#: About so many rows of both tables are a group of the cogrouped map.
BUCKET = 50_000


def cogrouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and balance of each customer, from two tables' groups. A group holds many customers, dealt by hash, as a call for each costs more than its rows; orders are counted before they meet, so a customer with many is one row."""

    def both(orders: pd.DataFrame, customer: pd.DataFrame) -> pd.DataFrame:
        n = customer["k"].map(orders.set_index("k")["n"]).fillna(0).astype("int64")
        return pd.DataFrame({"k": customer["k"], "n": n * customer["copies"], "c_acctbal": customer["c_acctbal"]})

    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    buckets = -(-(orders.count() + customer.count()) // BUCKET) or 1
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("bucket")
    counts = orders.filter("o_custkey IS NOT NULL").groupBy(F.col("o_custkey").alias("k")).agg(F.count("o_orderkey").alias("n")).select(bucket, "k", "n")
    customer = customer.groupBy(F.col("c_custkey").alias("k"), "c_acctbal").agg(F.count(F.lit(1)).alias("copies"))
    met = counts.groupBy("bucket").cogroup(customer.filter("k IS NOT NULL").select(bucket, "k", "copies", "c_acctbal").groupBy("bucket"))
    # a missing key meets nothing
    return met.applyInPandas(both, "k long, n long, c_acctbal double").union(customer.filter("k IS NULL").select("k", F.lit(0).cast("long"), "c_acctbal"))


def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_net(price double, discount double) RETURNS double RETURN round(price * (1 - discount), 4)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("tessera_net(l_extendedprice, l_discount)").alias("net"))


@F.udtf(returnType=StructType([StructField("word", StringType()), StructField("place", IntegerType())]))
class Words:
    """The words of a text with their places."""

    def eval(self, text: str):
        for k, word in enumerate(text.split(" ")):
            yield word, k


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("tessera_words", Words)
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, word, place FROM part, LATERAL tessera_words(p_name)")


@F.udtf(returnType=StructType([StructField("brand", StringType()), StructField("n", IntegerType()), StructField("largest", IntegerType())]))
class Sizes:
    """Count and largest size of the parts of a brand: state over a partition's rows, no rows kept."""

    def __init__(self) -> None:
        self.brand, self.n, self.largest = None, 0, 0

    def eval(self, row):
        self.brand, self.n, self.largest = row["p_brand"], self.n + 1, max(self.largest, row["p_size"])

    def terminate(self):
        yield self.brand, self.n, self.largest


def table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("tessera_sizes", Sizes)
    table(spark, sf_dir, "part").select("p_brand", "p_size").createOrReplaceTempView("tessera_parts")
    return spark.sql("SELECT brand, n, largest FROM tessera_sizes(TABLE(tessera_parts) PARTITION BY p_brand)")


_net = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem"
QUERIES = {
    "udf_plain_scalar": plain_scalar,
    "udf_arrow_scalar": arrow_scalar,
    "udf_pandas_map": pandas_map,
    "udf_grouped_arrow": grouped_arrow,
    "udf_table_argument": table_argument,
    "udf_pandas_aggregate": pandas_aggregate,
    "udf_pandas_window": pandas_over_window,
    "udf_arrow_map": arrow_map,
    "udf_grouped_map": grouped_map,
    "udf_cogrouped_map": cogrouped_map,
    "udf_sql_function": sql_function,
    "udf_pandas_scalar": pandas_scalar,
    "udf_table_function": table_function,
}
ORACLES = {
    "udf_plain_scalar": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') AS initials FROM part",
    "udf_arrow_scalar": "SELECT p_partkey, p_retailprice * 2 AS twice FROM part",
    "udf_pandas_map": "SELECT p_partkey, p_size FROM part WHERE p_size > 25",
    "udf_grouped_arrow": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey",
    "udf_table_argument": "SELECT p_brand AS brand, count(*)::int AS n, max(p_size) AS largest FROM part GROUP BY p_brand",
    "udf_pandas_aggregate": "SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_custkey",
    "udf_pandas_window": "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) - min(o_totalprice) OVER (PARTITION BY o_custkey) AS spread FROM orders",
    "udf_arrow_map": "SELECT p_partkey, length(p_name) AS n FROM part",
    "udf_grouped_map": "SELECT event_id, coalesce(round(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)), 3), -1) AS gap FROM events",
    "udf_cogrouped_map": "SELECT c_custkey AS k, count(o_orderkey) AS n, c_acctbal FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "udf_sql_function": _net,
    "udf_pandas_scalar": _net,
    "udf_table_function": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(range(len(string_split(p_name, ' '))))::int AS place FROM part",
}
