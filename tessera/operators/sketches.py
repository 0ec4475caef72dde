"""Sketches that are stored by period and united later: distinct counts and frequencies of any span of periods without a second scan of the rows."""

from __future__ import annotations

from math import e

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and buckets of the count-min tables: an estimate is over by more than e / WIDTH of all rows for one item in e^DEPTH at most.
DEPTH, WIDTH = 5, 2048
LG_K = 12


def distinct_by(df: DataFrame, period: Column, item: str) -> DataFrame:
    """(period, hll, theta): two sketches of the distinct items of each period, as bytes."""
    return df.groupBy(period.alias("period")).agg(F.hll_sketch_agg(item, LG_K).alias("hll"), F.theta_sketch_agg(item, LG_K).alias("theta"))


def united(sketches: DataFrame) -> DataFrame:
    """(hll, theta): estimates of the distinct items over all periods given."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("hll"), F.theta_sketch_estimate(F.theta_union_agg("theta")).cast("long").alias("theta"))


def cells(item: Column) -> Column:
    """An item's cell in each row of a count-min table."""
    return F.array(*(F.struct(F.lit(k).alias("row"), F.pmod(F.xxhash64(item, F.lit(k)), F.lit(WIDTH)).alias("bucket")) for k in range(DEPTH)))


def frequencies_by(df: DataFrame, period: Column, item: str) -> DataFrame:
    """(period, row, bucket, n): a count-min table of each period, DEPTH * WIDTH rows at most. Rows are counted by item before each count is dealt to its cells."""
    counts = df.filter(F.col(item).isNotNull()).groupBy(period.alias("period"), F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    dealt = counts.select("period", "n", F.explode(cells(F.col("item"))).alias("cell"))
    return dealt.groupBy("period", "cell.row", "cell.bucket").agg(F.sum("n").alias("n"))


def frequent_by(df: DataFrame, period: Column, item: str, share: float) -> DataFrame:
    """(period, item): what makes up the share or more of its period's rows, 1 / share items at most. Whatever makes up the share of a span of periods does so in one of them, so these are all candidates for any span."""
    counts = df.filter(F.col(item).isNotNull()).groupBy(period.alias("period"), F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("period").agg(F.sum("n").alias("total"))
    return counts.join(totals, "period").filter(F.col("n") >= F.lit(share) * F.col("total")).select("period", "item")


def estimated(tables: DataFrame, items: DataFrame) -> DataFrame:
    """(item, estimate, total) of the given items over all periods of the tables: never too low, and too high by more than ``slack`` of the total only rarely."""
    summed = tables.groupBy("row", "bucket").agg(F.sum("n").alias("n"))
    total = summed.filter("row = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    asked = items.select("item").distinct().withColumn("cell", F.explode(cells(F.col("item")))).select("item", "cell.row", "cell.bucket")
    # DEPTH * WIDTH cells at most, and one total
    found = asked.join(F.broadcast(summed), ["row", "bucket"], "left").groupBy("item").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
    return found.crossJoin(F.broadcast(total))


def slack() -> float:
    return e / WIDTH


def heavy(tables: DataFrame, candidates: DataFrame, share: float) -> DataFrame:
    """(item, estimate, total) of the items that make up the share of all rows or, by the sketch's error, nearly so."""
    return estimated(tables, candidates).filter(F.col("estimate") >= F.lit(share) * F.col("total"))
