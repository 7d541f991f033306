"""Joins that Spark's equi-joins don't cover: as-of and range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time.

    Both tables stand in one order per key and day; what a day begins with is
    the last row of an earlier day, so a hot key is split by days.
    """
    marked = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(right_time, *values)).schema[0].dataType).alias("_v"))
    other = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(right_time, *values).alias("_v"))
    for c in left.columns:
        if c != key:
            other = other.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    both = marked.unionByName(other).withColumn("_day", F.to_date("_t"))
    ends = both.filter("_side = 0").groupBy(key, "_day").agg(F.max("_v").alias("_end"))
    days = both.select(key, "_day").distinct().join(ends, [key, "_day"], "left")
    earlier = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    begins = days.select(key, "_day", F.last("_end", True).over(earlier).alias("_begin"))
    inside = Window.partitionBy(key, "_day").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_v", F.last("_v", True).over(inside)).filter("_side = 1").join(begins, [key, "_day"], "left")
    hit = F.coalesce("_v", "_begin")
    return filled.select(*[F.col(c) for c in left.columns], *[hit[v].alias(v) for v in values])


def interval_overlap(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of intervals [a0, a1) and [b0, b1) that overlap, met in buckets of ``width``; each pair once."""
    slots = lambda df, s, e: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    x, y = slots(a, "a0", "a1"), slots(b, "b0", "b1")
    first = F.floor(F.greatest("a0", "b0") / width)
    return x.join(y, "_b").filter((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")) & (F.col("_b") == first)).drop("_b")


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Inner join whose hot keys are spread over ``salts`` partitions; the other side is repeated as often."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in big.columns]), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")
