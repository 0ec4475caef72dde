"""Operations that DataFrames have as methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and status; a column for each status, of which there are few."""
    found = table(spark, sf_dir, "orders").crosstab("o_orderpriority", "o_orderstatus")
    return found.withColumnRenamed("o_orderpriority_o_orderstatus", "priority")


def quantile_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rank of an approximate median lies within the error that it was asked for."""
    orders = table(spark, sf_dir, "orders")
    (median,) = orders.approxQuantile("o_totalprice", [0.5], 0.01)
    return orders.agg((F.abs(F.avg((F.col("o_totalprice") <= median).cast("double")) - 0.5) <= 0.011).alias("near"))


def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as columns, their keys as the row."""
    return table(spark, sf_dir, "region").select("r_name", "r_regionkey").transpose("r_name").drop("key")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts gathered beside a query while it runs."""
    seen = Observation("orders")
    table(spark, sf_dir, "orders").observe(seen, F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["top"])], "n long, top long")


QUERIES = {"frame_crosstab": crosstab, "frame_quantile_bound": quantile_bound, "frame_transpose": transposed, "frame_observe": observed}
ORACLES = {
    "frame_crosstab": "SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
    "frame_quantile_bound": "SELECT true AS near",
    "frame_transpose": 'SELECT 0 AS "AFRICA", 1 AS "AMERICA", 2 AS "ASIA", 3 AS "EUROPE", 4 AS "MIDDLE EAST"',
    "frame_observe": "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders",
}
