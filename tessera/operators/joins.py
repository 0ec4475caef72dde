"""Joins that Spark has no single operator for, composed of the ones it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """Each left row with ``value`` of the latest right row of its key that isn't later (null if there is none).

    One shuffle on the key: both sides are laid over each other and the last
    value seen is carried on, so no pairs are made. A right row counts for left
    rows of the same instant. Rows whose key or instant is null find nothing.
    """
    names = left.columns
    keep = F.struct(*names)
    both = left.select(*by, on, F.lit(1).alias("side_"), keep.alias("row_"), F.lit(None).cast(right.schema[value].dataType).alias("seen_")).unionByName(
        right.select(*by, on, F.lit(0).alias("side_"), F.lit(None).cast(left.select(keep.alias("x")).schema["x"].dataType).alias("row_"), F.col(value).alias("seen_")).filter(F.col(on).isNotNull())
    )
    so_far = Window.partitionBy(*by).orderBy(on, "side_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("seen_", F.last("seen_", ignorenulls=True).over(so_far)).filter("side_ = 1")
    known = F.col(on).isNotNull()
    for k in by:
        known &= F.col(k).isNotNull()
    return found.select("row_.*", F.when(known, F.col("seen_")).alias(f"{value}_asof"))


def asof_in_slices(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, seconds: int) -> DataFrame:
    """The rows of ``asof``, where no task holds a key: time is cut into slices of so many seconds, and only (key, slice) is kept together.

    The last value of each key and slice, added up before the shuffle, is carried on
    over the slices: a key has as many such rows as it has slices, however many
    rows these hold. What a slice begins with then comes as one row more into
    it. ``on`` is a timestamp, with or without a zone. Of right rows of one key and instant the largest value counts.
    """
    slice_of = F.floor(F.unix_micros(F.col(on).cast("timestamp")) / F.lit(seconds * 1_000_000))
    kind = left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType
    known = right.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [on, *by])).withColumn("slice_", slice_of)
    asking = left.select(*by, on, slice_of.alias("slice_"), F.struct(*left.columns).alias("row_"))
    last = known.filter(F.col(value).isNotNull()).groupBy(*by, "slice_").agg(F.max(F.struct(on, value))[value].alias("last_"))
    places = asking.select(*by, "slice_").distinct().join(last, [*by, "slice_"], "full")
    earlier = Window.partitionBy(*by).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    begins = places.withColumn("seen_", F.last("last_", ignorenulls=True).over(earlier)).filter("seen_ IS NOT NULL")
    none = lambda t: F.lit(None).cast(t)
    both = (
        asking.select(*by, "slice_", on, F.lit(2).alias("side_"), "row_", none(right.schema[value].dataType).alias("seen_"))
        .unionByName(known.select(*by, "slice_", on, F.lit(1).alias("side_"), none(kind).alias("row_"), F.col(value).alias("seen_")))
        .unionByName(begins.select(*by, "slice_", none(left.schema[on].dataType).alias(on), F.lit(0).alias("side_"), none(kind).alias("row_"), "seen_"))
    )
    so_far = Window.partitionBy(*by, "slice_").orderBy(F.asc_nulls_first(on), "side_", F.asc_nulls_first("seen_")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("seen_", F.last("seen_", ignorenulls=True).over(so_far)).filter("side_ = 2")
    sound = F.col(on).isNotNull()
    for c in by:
        sound &= F.col(c).isNotNull()
    return found.select("row_.*", F.when(sound, F.col("seen_")).alias(f"{value}_asof"))


def level_of(length: Column, width: float) -> Column:
    """The least k for which width * 4^k is as long as the length."""
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(length / F.lit(width), F.lit(1.0))) - F.lit(1e-9))).cast("int")


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows whose spans (first, last; both ends belong to them) have a point in common, by an equi-join.

    A span lies on the level whose buckets, width * 4^level wide, are as long as
    it, so it meets two of them at most; it is dealt to the buckets of its own
    level and of each coarser one that the other side has. A pair is made on the
    coarser of both spans' levels, in the first bucket that both meet, so once.
    Long and short spans mix without many copies: a row has at most two for each
    level. Spans with a null end, or that end before they begin, meet nothing.
    Columns of the two sides must have different names.
    """

    def leveled(df: DataFrame, span: tuple[str, str], tag: str) -> DataFrame:
        a, b = (F.col(c).cast("double") for c in span)
        return df.filter(a <= b).withColumns({f"{tag}a_": a, f"{tag}b_": b, f"{tag}level_": level_of(b - a, width)})

    sides = {"l": leveled(left, left_span, "l"), "r": leveled(right, right_span, "r")}
    # at most one row for each level, and levels are the logarithm of the longest span
    levels = {tag: sorted(r[0] for r in df.select(f"{tag}level_").distinct().collect()) for tag, df in sides.items()}

    def dealt(tag: str, other: str) -> DataFrame:
        own, wide = F.col(f"{tag}level_"), lambda level: F.lit(width) * F.pow(F.lit(4.0), level)
        coarser = F.filter(F.array(*map(F.lit, levels[other])).cast("array<int>"), lambda k: k > own)
        there = sides[tag].withColumn("level_", F.explode(F.concat(F.array(own), coarser)))
        first = F.floor(F.col(f"{tag}a_") / wide(F.col("level_")))
        there = there.withColumns({f"{tag}first_": first, f"{tag}last_": F.floor(F.col(f"{tag}b_") / wide(F.col("level_")))})
        return there.withColumn("bucket_", F.explode(F.sequence(f"{tag}first_", f"{tag}last_")))

    pairs = dealt("l", "r").join(dealt("r", "l"), ["level_", "bucket_"])
    once = (F.col("level_") == F.greatest("llevel_", "rlevel_")) & (F.col("bucket_") == F.greatest("lfirst_", "rfirst_"))
    met = (F.col("la_") <= F.col("rb_")) & (F.col("ra_") <= F.col("lb_"))
    return pairs.filter(once & met).select(*left.columns, *right.columns)


def within_range(left: DataFrame, right: DataFrame, left_on: str, right_on: str, reach: float) -> DataFrame:
    """Pairs whose numbers differ by ``reach`` at most, by an equi-join on buckets of that width: a left row is in its own bucket, a right row in its own and both neighbours."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(reach)))
    a = left.withColumn("bucket_", bucket(left_on))
    b = right.withColumn("bucket_", F.explode(F.sequence(bucket(right_on) - 1, bucket(right_on) + 1)))
    return a.join(b, "bucket_").filter(F.abs(F.col(left_on) - F.col(right_on)) <= reach).drop("bucket_")


def salted(left: DataFrame, right: DataFrame, on: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread: each left row takes one of ``salts`` places, each right row all of them."""
    a = left.withColumn("salt_", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [on, "salt_"], how).drop("salt_")


def upsert(target: DataFrame, changes: DataFrame, key: list[str], deleted: Column | None = None) -> DataFrame:
    """The target with rows of the changes' keys replaced by the changes; those for which ``deleted`` holds only go."""
    untouched = target.join(changes.select(*key).distinct(), key, "left_anti")
    added = changes if deleted is None else changes.filter(~F.coalesce(deleted, F.lit(False)))
    return untouched.unionByName(added.select(*target.columns))
