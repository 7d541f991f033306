"""Questions about one table: aggregates, thresholds, top rows, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALARS = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}


def scalar(df: DataFrame, how: str, column: str) -> DataFrame:
    return df.agg(F.round(SCALARS[how](column), 2).alias("v"))


def above_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows above an exact, interpolated quantile; the threshold is one broadcast row."""
    limit = df.agg(F.percentile(column, F.lit(q)).alias("_limit"))
    return df.select(column).join(F.broadcast(limit), F.col(column) > F.col("_limit")).agg(F.count("*").alias("n"))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The order must break ties: a top-k of each partition meets in one small merge."""
    return df.orderBy(*order).limit(n)


def group_top(df: DataFrame, key: str, value: str, n: int, descending: bool) -> DataFrame:
    total = df.groupBy(key).agg(F.round(F.sum(value), 2).alias("v"))
    return total.orderBy(F.desc("v") if descending else F.asc("v"), key).limit(n)


def equal_above_mean(df: DataFrame, key: str, wanted: str, value: str) -> DataFrame:
    mean = df.agg(F.avg(value).alias("_mean"))
    return df.filter(F.col(key) == wanted).select(value).join(F.broadcast(mean), F.col(value) > F.col("_mean")).agg(F.count("*").alias("n"))


def global_position(df: DataFrame, key: str, stretches: int = 64, out: str = "pos") -> DataFrame:
    """0-based position in the order of a numeric key, without sorting in one task.

    Approximate quantiles cut the key's range into stretches; counts per
    stretch give their offsets, a window per stretch the place inside.  Equal
    keys are one stretch, so their order among each other is by all columns.
    """
    marks = [i / stretches for i in range(1, stretches)]
    bounds = sorted({b for b in (df.agg(F.percentile_approx(key, F.lit(marks), F.lit(10_000))).first()[0] or []) if b is not None})
    cut = df.withColumn("_at", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>"), lambda b: b < F.col(key))))
    counts = cut.groupBy("_at").agg(F.count("*").alias("_n"))
    offsets = counts.select("_at", F.coalesce(F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_at").orderBy(F.asc_nulls_last(key), *[c for c in df.columns if c != key])
    placed = cut.withColumn(out, F.row_number().over(inside) - 1)
    return placed.join(F.broadcast(offsets), "_at").withColumn(out, F.col(out) + F.col("_before")).drop("_at", "_before")


def shards(df: DataFrame, key: str, n: int) -> DataFrame:
    """Contiguous shards in the order of ``key``; the first ones are one row longer."""
    total = df.agg(F.count("*").alias("_rows"))
    size, extra = F.floor(F.col("_rows") / n), F.col("_rows") % n
    long_part = extra * (size + 1)
    shard = F.when(F.col("pos") < long_part, F.floor(F.col("pos") / (size + 1))).otherwise(extra + F.floor((F.col("pos") - long_part) / F.greatest(size, F.lit(1))))
    return global_position(df, key).join(F.broadcast(total)).withColumn("shard", (shard + 1).cast("int")).drop("_rows")
