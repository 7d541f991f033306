"""Distributed prefix sums inside groups, in random or given order.

A global sort of a hot group would end in one task.  A row's random key is a
hash of the row, so equal slices of the key range hold about equally many
rows of every group however large it is.  Sums per (group, slice) are
pre-aggregated before the shuffle, their prefix sums are the offsets of the
slices, and one window per slice adds the sum inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 12


def hash_key(seed: int, *cols: Column) -> Column:
    """A non-negative 63-bit random key, the same for the same row and seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def slice_of(key: Column, bits: int = SLICE_BITS) -> Column:
    """The slice of the key range; it grows with the key."""
    return F.shiftright(key, 63 - bits).cast("int")


def slice_sums(df: DataFrame, group: list[str], slice_col: str, weight: Column, total: str) -> DataFrame:
    """Sum of ``weight`` for each group and slice."""
    return df.groupBy(*group, slice_col).agg(F.sum(weight).alias(total))


def slice_offsets(sums: DataFrame, group: list[str], slice_col: str, total: str, offset: str) -> DataFrame:
    """What lies before each slice in its group: at most 2**SLICE_BITS rows a group."""
    before = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, slice_col, F.coalesce(F.sum(total).over(before), F.lit(0)).cast("long").alias(offset))


def with_prefix(df: DataFrame, offsets: DataFrame, group: list[str], slice_col: str, order: list[str], weight: Column, offset: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` up to and with this row in its group."""
    inside = Window.partitionBy(*group, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn(out, F.sum(weight).over(inside))
    return summed.join(offsets, [*group, slice_col]).withColumn(out, F.col(out) + F.col(offset)).drop(offset)
