"""Problem 1: a sample whose shares of categories follow given targets.

Systematic sampling with unequal probabilities.  Rows stand in random order
inside their category, categories stand sorted, and the inclusion
probabilities are summed up along that line.  From one random start every
integer that the running sum crosses selects a row.  Categories left under
their floor are then topped up, and as many rows are taken from those with
most to spare.

The running sum never needs one ordered pass: the probability is the same for
all rows of a category, so the sum at a row is base(category) + rank *
probability, and the rank comes from the sliced prefix counts of
``prefix.py``.

Defined results.  Rows with null level or null mode are in no category and
are never drawn, as are rows of a category without target.  A category with
fewer rows than its target gives all its rows; the others share what is
missing by their targets.  Repeated rows count and can be drawn each.  Ties
of the random key are broken by the key columns.  An empty table, or one
without any matching category, gives an empty sample and a report in which
every category falls short.  Columns named like the operator's own (``_OWN``)
are left out of the result; all others are kept, whatever their names.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import prefix
from loomwork.scratch import drop_clashing

BLANKS = r"[\s\p{Z}\p{Pd}_\x{85}\x{1c}-\x{1f}]"
STATS = "_cat int, level int, mode string, available long, wanted double, min_rows long, target_share double, sample_rows long"
PLAN = f"{STATS}, base double, expected double, crossed long, add long, remove long, start double"
_EPS = 1e-9
#: Columns that the operator works with; those of the input are left out.
_OWN = ("_cat", "_key", "_slice", "_n", "_before", "_rank", "_l", "_m", "_drawn", "_available", "_base", "_expected", "_add", "_remove", "_start")


def plain_mode(mode: Column) -> Column:
    """A mode without case, white space, hyphens and underscores."""
    return F.regexp_replace(F.lower(mode), BLANKS, "")


def _spread(pdf: pd.DataFrame) -> list[float]:
    """Expected rows per category: targets, capped at what is there, the rest shared out again by target."""
    size = min(float(pdf["sample_rows"].max()), float(pdf["available"].sum()))
    share, cap = [float(x) for x in pdf["target_share"]], [float(x) for x in pdf["available"]]
    expected, open_ = [0.0] * len(cap), [i for i, s in enumerate(share) if s > 0]
    left = size
    while open_:
        total = sum(share[i] for i in open_)
        full = [i for i in open_ if left * share[i] / total >= cap[i]]
        if not full:
            for i in open_:
                expected[i] = left * share[i] / total
            break
        for i in full:
            expected[i] = cap[i]
        left -= sum(cap[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return expected


def _plan(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One row per category: its stretch of the line and the repairs of its floor."""
    pdf = pdf.sort_values("_cat").reset_index(drop=True)
    expected = _spread(pdf)
    start = random.Random(seed).random()
    base, at = [], 0.0
    for e in expected:
        base.append(at)
        at += e
    ends = [*base[1:], at]
    # the line ends at a whole number when all shares can be met; rounding must not lose its last crossing
    cross = lambda x: int((round(x) if abs(x - round(x)) < _EPS else x) + start)
    crossed = [cross(b) - cross(a) for a, b in zip(base, ends, strict=True)]
    crossed = [min(c, int(n)) for c, n in zip(crossed, pdf["available"], strict=True)]
    floor = [min(int(m), int(n)) for m, n in zip(pdf["min_rows"], pdf["available"], strict=True)]
    add = [max(0, f - c) for f, c in zip(floor, crossed, strict=True)]
    remove, need = [0] * len(add), sum(add) + max(0, sum(crossed) - int(pdf["sample_rows"].max()))
    spare = [max(0, c - max(f, 0)) if not a else 0 for c, f, a in zip(crossed, floor, add, strict=True)]
    total = sum(spare)
    if need and total:
        need = min(need, total)
        exact = [need * s / total for s in spare]
        remove = [int(x) for x in exact]
        for i in sorted(range(len(exact)), key=lambda i: (remove[i] - exact[i], i))[: need - sum(remove)]:
            remove[i] += 1
    return pdf.assign(base=base, expected=expected, crossed=crossed, add=add, remove=remove, start=start)


def _categories(targets: DataFrame) -> DataFrame:
    """The targets with a sorted number; one row per category."""
    ranked = F.row_number().over(prefix.Window.partitionBy(F.lit(0)).orderBy("level", "_mode"))
    return targets.select("level", "mode", "target_share", F.col("min_rows").cast("long").alias("min_rows"), F.col("sample_rows").cast("long").alias("sample_rows"), plain_mode(F.col("mode")).alias("_mode")).dropDuplicates(["level", "_mode"]).withColumn("_cat", ranked)


def _tagged(df: DataFrame, categories: DataFrame, seed: int, key_cols: list[str]) -> DataFrame:
    """Rows in a category, with their number, random key and slice."""
    known = categories.select(F.col("level").alias("_l"), F.col("_mode").alias("_m"), "_cat")
    keyed = df.withColumn("_key", prefix.hash_key(seed, *[F.col(f"`{c}`") for c in key_cols]))
    return keyed.join(known, (F.col("level") == F.col("_l")) & (plain_mode(F.col("mode")) == F.col("_m"))).drop("_l", "_m").withColumn("_slice", prefix.slice_of(F.col("_key")))


def plan_sample(df: DataFrame, targets: DataFrame, seed: int = 7, key_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan by category, the tagged rows, and their counts by category and slice."""
    df = drop_clashing(df, *_OWN)
    categories = _categories(targets)
    rows = _tagged(df, categories, seed, key_cols or [c for c, t in df.dtypes if not t.startswith(("map", "variant"))])
    counts = prefix.slice_sums(rows, ["_cat"], "_slice", F.lit(1), "_n")
    known = counts.groupBy("_cat").agg(F.sum("_n").alias("available"))
    stats = categories.join(known, "_cat", "left").select("_cat", "level", "mode", F.coalesce("available", F.lit(0)).cast("long").alias("available"), F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_rows")).alias("wanted"), "min_rows", "target_share", "sample_rows")
    # as many rows as the target table has, whatever the size of the data
    return stats.groupBy(F.lit("all")).applyInPandas(lambda pdf: _plan(pdf, seed), PLAN), rows, counts


def draw(df: DataFrame, targets: DataFrame, seed: int = 7, key_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan by category, and every row of a category with ``_cat`` and whether it is ``_drawn``."""
    plan, rows, counts = plan_sample(df, targets, seed, key_cols)
    offsets = prefix.slice_offsets(counts, ["_cat"], "_slice", "_n", "_before")
    ranked = prefix.with_prefix(rows, offsets, ["_cat"], "_slice", ["_key", *(key_cols or [])], F.lit(1), "_before", "_rank")
    joined = ranked.join(plan.select("_cat", *[F.col(c[1:]).alias(c) for c in _OWN[-6:]]), "_cat")
    end = lambda x: F.floor(F.when(F.abs(x - F.round(x)) < _EPS, F.round(x)).otherwise(x) + F.col("_start"))
    at = lambda r: end(F.when(r == F.col("_available"), F.col("_base") + F.col("_expected")).otherwise(F.col("_base") + F.col("_expected") * (r / F.col("_available"))))
    hits = at(F.col("_rank")) - end(F.col("_base"))  # selected up to and with this row
    crossed = at(F.col("_rank")) > at(F.col("_rank") - 1)
    kept = (crossed & (hits > F.col("_remove"))) | (~crossed & (F.col("_rank") - hits <= F.col("_add")))
    return plan, joined.withColumn("_drawn", kept)


def sample_to_targets(df: DataFrame, targets: DataFrame, seed: int = 7, key_cols: list[str] | None = None) -> DataFrame:
    """The rows of the sample, with the columns of ``df``."""
    _, rows = draw(df, targets, seed, key_cols)
    return rows.filter("_drawn").select(*[F.col(f"`{c}`") for c in drop_clashing(df, *_OWN).columns])


def sample_report(df: DataFrame, targets: DataFrame, seed: int = 7, key_cols: list[str] | None = None) -> DataFrame:
    """Per category: rows there, wanted and drawn, its share, and whether the target can't be met.

    All of it is counted in the drawn sample: a target can't be met where
    fewer rows than wanted were drawn although none was left over.
    """
    plan, rows = draw(df, targets, seed, key_cols)
    drawn = rows.groupBy("_cat").agg(F.sum(F.col("_drawn").cast("long")).alias("taken"), F.sum((~F.col("_drawn")).cast("long")).alias("left_over"))
    out = plan.join(drawn, "_cat", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("taken", "left_over")})
    short = (F.col("taken") < F.col("wanted") - _EPS) & (F.col("left_over") == 0)
    return out.select("level", "mode", (F.col("taken") + F.col("left_over")).alias("available"), "wanted", "min_rows", "target_share", "sample_rows", "taken", (F.col("taken") / F.col("sample_rows")).alias("actual_share"), short.alias("short"))


def short_categories(df: DataFrame, targets: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """Categories, as the targets write them, whose target the drawn sample could not meet."""
    return sample_report(df, targets, key_cols=key_cols).filter("short").select("level", "mode")
