"""Gates, balanced batches, budgets and interleaving of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import prefix


def words(text: Column) -> Column:
    """Pieces between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s\x{85}\x{1c}-\x{1f}\p{Z}]+")), F.lit(0))


def token_gate(df: DataFrame, text: str, most: int) -> DataFrame:
    return df.filter(words(F.col(text)) <= most)


def balanced_batch(df: DataFrame, order: list[str], dedup: str, balance: str, cap: int, size: int) -> DataFrame:
    """First of each dedup key, then at most ``cap`` of each balancing key, then the first ``size`` in order.

    Equal to accepting one row after the other wherever the balancing key
    follows from the dedup key.  Null keys are neither repeated nor capped.
    Only the first ``cap`` rows of a key can be kept, so each slice of a hot
    key is cut before its rows meet.
    """
    cols = [F.col(c) for c in order]
    first = df.filter(F.col(dedup).isNull()).unionByName(_first_of(df.filter(F.col(dedup).isNotNull()), dedup, order))
    capped = first.filter(F.col(balance).isNotNull()).withColumn("_s", F.pmod(F.xxhash64(*cols), F.lit(64)))
    for part in (["_s"], []):
        w = Window.partitionBy(balance, *part).orderBy(*cols)
        capped = capped.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= cap).drop("_k")
    return capped.drop("_s").unionByName(first.filter(F.col(balance).isNull())).orderBy(*cols).limit(size)


def _first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by partial aggregation."""
    rest = [c for c in df.columns if c != key and c not in order]
    best = df.groupBy(key).agg(F.min(F.struct(*[c for c in order if c != key], *rest)).alias("_b"))
    return best.select(*[F.col(key) if c == key else F.col(f"_b.{c}") for c in df.columns])


def token_budget(df: DataFrame, order_key: str, tokens: Column, budget: int, skip: int = 0, longest: int = 1 << 30) -> DataFrame:
    """Rows in the order of a whole-number key until their tokens reach the budget, the one that crosses it included.

    Prefix sums go by stretches of the key, so no task sorts the whole table.
    """
    kept = df.filter(tokens <= longest).withColumn("_t", tokens)
    lo, hi = kept.agg(F.min(order_key), F.max(order_key)).first()
    width = max(1, ((hi or 0) - (lo or 0)) // 256 + 1)
    cut = kept.withColumn("_g", F.lit(0)).withColumn("_slice", F.floor((F.col(order_key) - F.lit(lo or 0)) / width).cast("int"))
    place = lambda weight, out: prefix.with_prefix(cut, prefix.slice_offsets(prefix.slice_sums(cut, ["_g"], "_slice", weight, "_w"), ["_g"], "_slice", "_w", "_b"), ["_g"], "_slice", [order_key], weight, "_b", out)
    if skip:
        cut = place(F.lit(1), "_n").filter(F.col("_n") > skip).drop("_n")
    return place(F.col("_t"), "_sum").filter(F.col("_sum") - F.col("_t") < budget).drop("_g", "_slice", "_sum", "_t")


def hash_sample(df: DataFrame, by: list[str], key: Column, n: int) -> DataFrame:
    """``n`` rows of each group with the smallest hashes."""
    h = F.md5(key)
    sliced = df.withColumn("_h", h).withColumn("_s", F.pmod(F.xxhash64("_h"), F.lit(64)))
    for part in (["_s"], []):
        sliced = sliced.withColumn("_k", F.row_number().over(Window.partitionBy(*by, *part).orderBy("_h"))).filter(F.col("_k") <= n).drop("_k")
    return sliced.drop("_h", "_s")


def interleave(main: DataFrame, side: DataFrame, ratio: float, seed: str = "42") -> DataFrame:
    """Both tables in one hash order, the side table thinned to ``ratio`` rows for each of the main one."""
    u = lambda c: F.conv(F.substring(F.md5(F.concat(F.lit(seed), c.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    thin = side.filter(u(F.col("id")) < ratio)
    return main.withColumn("origin", F.lit("main")).unionByName(thin.withColumn("origin", F.lit("side"))).withColumn("place", u(F.concat("origin", F.col("id").cast("string"))))
