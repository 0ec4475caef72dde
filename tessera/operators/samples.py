"""Samples of exact size in each stratum, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a stratum is dealt to before what is left of it is ranked together.
PARTS = 32


def stratified(df: DataFrame, strata: list[str], key: list[str], size: int | dict, seed: int = 0) -> DataFrame:
    """Of each stratum the ``size`` rows (all, if it has fewer) whose seeded hashes are least.

    ``size`` is one number for all strata, or one for each value of the only
    stratum column (strata that aren't named give no rows). The hash is the md5 of
    the seed and the key columns joined by '|', nulls as empty; ``key`` should tell
    rows apart, as rows with equal keys tie and are then told by all their columns.
    A stratum is cut down in parts first, so however large it is, one task meets
    ``size`` rows of each part at most. A null stratum is one of its own.
    """
    if isinstance(size, dict):
        if len(strata) != 1:
            raise ValueError("sizes by value need one stratum column")
        wanted = F.lit(0)
        for value, n in size.items():
            wanted = F.when(F.col(strata[0]).eqNullSafe(F.lit(value)), n).otherwise(wanted)
    else:
        wanted = F.lit(size)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    rows = df.withColumns({"digest_": F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), "wanted_": wanted}).filter("wanted_ > 0")
    order = [F.col("digest_"), F.xxhash64(*df.columns)]

    def least(rows: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("rank_", rank).filter("rank_ <= wanted_")

    few = least(rows.withColumn("part_", F.pmod(F.xxhash64("digest_"), F.lit(PARTS))), *strata, "part_")
    return least(few, *strata).select(*df.columns)


def shares(df: DataFrame, strata: list[str], key: list[str], share: float, seed: int = 0) -> DataFrame:
    """Of each stratum the same share of its rows, rounded up, chosen as ``stratified`` does. Counts are added up before the shuffle; the ranks are those of the whole stratum, from the counts of ranges of the hash."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    rows = df.withColumn("digest_", F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))).withColumn("range_", F.substring("digest_", 1, 2))
    counts = rows.groupBy(*strata, "range_").agg(F.count(F.lit(1)).alias("n_"))
    # 256 ranges of the hash for each stratum: rows of the earlier ones are known without ranking them
    before = Window.partitionBy(*strata).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    bounds = counts.withColumns({"before_": F.coalesce(F.sum("n_").over(before), F.lit(0)), "wanted_": F.ceil(F.sum("n_").over(Window.partitionBy(*strata)) * F.lit(share).cast("decimal(18,9)"))}).filter("before_ < wanted_")
    on = None
    named = bounds.select(*(F.col(c).alias(f"{c}_of_") for c in strata), F.col("range_").alias("range_of_"), "n_", "before_", "wanted_")
    for c in strata:
        on = F.col(c).eqNullSafe(F.col(f"{c}_of_")) if on is None else on & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
    met = rows.join(named, on & (F.col("range_") == F.col("range_of_")))
    whole, cut = met.filter("before_ + n_ <= wanted_"), met.filter("before_ + n_ > wanted_")
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("digest_", F.xxhash64(*df.columns)))
    return whole.select(*df.columns).unionByName(cut.withColumn("rank_", rank).filter("before_ + rank_ <= wanted_").select(*df.columns))
