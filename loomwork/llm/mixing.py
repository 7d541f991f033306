"""Problem 4: a mix of sources with target weights.

Rows get a hash-random key, stand in its order inside their source, and the
prefix sums of their token counts say where the source's budget is cut.  A
source smaller than its budget is passed several times, at most
``max_passes``; all but the last pass are whole.  Order and prefix sums are
distributed (``prefix.py``): no source, however large, is sorted in one task.

Defined results.  Rows with the same row_id are one row (the first by its
content); rows without row_id stay separate rows.  Null text has no tokens.
Rows without source, or with a source that has no target, are not used.  The
row at the cut is used if that brings the source nearer to its budget; rows
without tokens before the cut are used too.  A source without rows or tokens
contributes nothing and is reported as short.  Empty tables give an empty mix
and a report with a row per target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import prefix

#: A piece between white space, Unicode's included.
PIECE = r"[^\s\x{85}\x{1c}-\x{1f}\p{Z}]+"
_EPS = 1e-6


def piece_count(text: Column) -> Column:
    """Pieces between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(PIECE)), F.lit(0)).cast("long")


def distinct_rows(df: DataFrame) -> DataFrame:
    """One row per row_id, the same one in every run; rows without row_id all stay."""
    others = [c for c in df.columns if c != "row_id"]
    known = df.filter("row_id IS NOT NULL").groupBy("row_id").agg(F.min(F.struct(*others)).alias("_r")).select("row_id", *[F.col("_r")[c].alias(c) for c in others])
    return known.unionByName(df.filter("row_id IS NULL"))


def _counted(df: DataFrame) -> DataFrame:
    rows = distinct_rows(df.select("row_id", "source", "prompt", "completion"))
    return rows.filter("source IS NOT NULL").select("row_id", "source", (piece_count(F.col("prompt")) + piece_count(F.col("completion"))).alias("tokens"), prefix.hash_key(11, F.col("row_id"), F.col("prompt"), F.col("completion")).alias("_key")).withColumn("_slice", prefix.slice_of(F.col("_key")))


def _budgets(targets: DataFrame, sums: DataFrame) -> DataFrame:
    """Per source: budget, tokens there, whole passes and what the last pass must give."""
    there = sums.groupBy("source").agg(F.sum("_t").alias("available"))
    joined = targets.join(there, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    budget = F.col("weight") * F.col("total_tokens")
    reach = F.least(budget, (F.col("available") * F.col("max_passes")).cast("double"))
    whole = F.when(F.col("available") > 0, F.floor((reach + _EPS) / F.col("available"))).otherwise(0)
    return joined.select("source", "weight", "max_passes", "total_tokens", budget.alias("budget"), "available", F.least(whole, F.col("max_passes")).cast("int").alias("whole"), reach.alias("reach")).withColumn("rest", F.greatest(F.lit(0.0), F.col("reach") - F.col("whole") * F.col("available")))


def use_rows(df: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, row_id, tokens, max_passes, uses): every row of a wanted source and how often the mix uses it."""
    rows = _counted(df)
    sums = prefix.slice_sums(rows, ["source"], "_slice", F.col("tokens"), "_t")
    offsets = prefix.slice_offsets(sums, ["source"], "_slice", "_t", "_before")
    placed = prefix.with_prefix(rows, offsets, ["source"], "_slice", ["_key", "row_id", "tokens"], F.col("tokens"), "_before", "_sum")
    joined = placed.join(_budgets(targets, sums).select("source", "whole", "rest", "max_passes"), "source")
    # the middle of the row lies before the cut: using it brings the source nearer to its budget
    extra = (F.col("rest") > _EPS) & (F.col("_sum") - F.col("tokens") / 2 <= F.col("rest"))
    return joined.select("source", "row_id", "tokens", "max_passes", (F.col("whole") + F.when(extra, 1).otherwise(0)).alias("uses"))


def mix_sources(df: DataFrame, targets: DataFrame) -> DataFrame:
    """The mix: (source, row_id, pass, tokens), a row for each use."""
    return use_rows(df, targets).filter("uses > 0").select("source", "row_id", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("pass"), "tokens")


def mix_report(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: weight asked for and reached, tokens there and used, and whether it falls short.

    All of it is summed up over the cut mix: a source falls short where less
    than its budget is used although every row is used as often as allowed.
    """
    uses, tokens = F.col("uses"), F.col("tokens")
    used = use_rows(df, targets).groupBy("source").agg(
        F.sum(uses * tokens).alias("used"),
        F.sum((F.col("max_passes") - uses) * tokens).alias("unused"),
        F.sum(tokens).alias("available"),
        F.sum(uses.cast("long")).alias("rows_used"),
        F.max(uses).alias("passes"),
    )
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("used", "unused", "available", "rows_used", "passes")}
    out = targets.select("source", "weight", "max_passes", (F.col("weight") * F.col("total_tokens")).alias("budget")).join(used, "source", "left").withColumns(filled)
    all_ = F.sum("used").over(prefix.Window.partitionBy(F.lit(0)))  # one row per source of the targets
    short = (F.col("used") < F.col("budget") - _EPS) & (F.col("unused") == 0)
    return out.select("source", "weight", "max_passes", "budget", "available", "used", "rows_used", "passes", F.try_divide(F.col("used").cast("double"), all_.cast("double")).alias("actual_share"), short.alias("short"))


def short_sources(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources of which the cut mix holds less than their budget, all their rows used ``max_passes`` times."""
    return mix_report(df, targets).filter("short").select("source")
