"""Extremes over window frames without the current row's peers, which can't be subtracted from a maximum as from a sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAMES = ("all", "so_far", "from_here")


def extremes(df: DataFrame, by: list[str], order: str, value: str, exclude: str, frame: str = "all", name: str = "x") -> DataFrame:
    """The rows with ``name_max`` and ``name_min`` of ``value`` over the frame of their partition (all of it, RANGE up to the current row, RANGE from it on), EXCLUDE CURRENT ROW, GROUP or TIES.

    Peers are rows equal in ``order`` (nulls are peers and come first). Each group
    of peers is first added up to its extremes, before the shuffle, with how
    often each occurs and the runner-up; then the groups before come as a running
    extreme in the order, those after as a running extreme in reverse, so neither
    frame is gone over again for each row. A partition's window holds a row for
    each distinct value of ``order``; its rows meet these again by a join on both.
    Null values don't count; a frame without values gives null.
    """
    if frame not in FRAMES or exclude not in ("CURRENT ROW", "GROUP", "TIES"):
        raise ValueError(f"no frame {frame} with EXCLUDE {exclude}")
    keys = [*by, order]
    # of each value of a group: how often it occurs, so that one row can be taken out of its group
    values = df.groupBy(*keys, F.col(value).alias("v_")).agg(F.count(F.lit(1)).alias("n_"))
    pair = F.when(F.col("v_").isNotNull(), F.struct("v_", "n_"))
    ends = values.groupBy(*keys).agg(F.max(pair).alias("top_"), F.min(pair).alias("low_"), F.max("v_").alias("max_"), F.min("v_").alias("min_"))
    mine = lambda df, names: [df[c].eqNullSafe(names[f"{c}_of_"]) for c in keys]
    best = ends.select(*(F.col(c).alias(f"{c}_of_") for c in keys), F.col("max_").alias("best_"), F.col("min_").alias("least_"))
    beyond = values.join(best, mine(values, best)).groupBy(*keys).agg(F.max(F.when(F.col("v_") < F.col("best_"), F.col("v_"))).alias("max2_"), F.min(F.when(F.col("v_") > F.col("least_"), F.col("v_"))).alias("min2_"))
    beyond = beyond.select(*(F.col(c).alias(f"{c}_of_") for c in keys), "max2_", "min2_")
    groups = ends.join(beyond, mine(ends, beyond)).select(*keys, "top_", "low_", "max_", "min_", "max2_", "min2_")
    past = Window.partitionBy(*by).orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(F.desc_nulls_last(order)).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns({f"{f}_{side}_": (F.max if f == "max" else F.min)(f"{f}_").over(w) for f in ("max", "min") for side, w in (("past", past), ("ahead", ahead))})
    sides = {"all": ("past", "ahead"), "so_far": ("past",), "from_here": ("ahead",)}[frame]
    named = groups.select(*(F.col(c).alias(f"{c}_of_") for c in keys), *(F.col(c) for c in groups.columns if c not in keys))
    joined = df.join(named, mine(df, named))

    def over(f: str, end: str) -> Column:
        own = {
            "GROUP": F.lit(None),
            "TIES": F.col(value),
            "CURRENT ROW": F.when(F.col(value).eqNullSafe(F.col(f"{f}_")) & (F.col(f"{end}_.n_") == 1), F.col(f"{f}2_")).otherwise(F.col(f"{f}_")),
        }[exclude]
        return (F.greatest if f == "max" else F.least)(own.cast(df.schema[value].dataType), F.lit(None).cast(df.schema[value].dataType), *(F.col(f"{f}_{s}_") for s in sides))

    return joined.select(*df.columns, over("max", "top").alias(f"{name}_max"), over("min", "low").alias(f"{name}_min"))
