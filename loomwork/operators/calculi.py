"""Qualitative relations between intervals and boxes, and reasoning with them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Allen's thirteen relations by the signs of (start-start, start-end, end-start, end-end); fixed values.
ALLEN = {
    "before": (-1, -1, -1, -1), "meets": (-1, -1, 0, -1), "overlaps": (-1, -1, 1, -1), "finished-by": (-1, -1, 1, 0), "contains": (-1, -1, 1, 1),
    "starts": (0, -1, 1, -1), "equals": (0, -1, 1, 0), "started-by": (0, -1, 1, 1), "during": (1, -1, 1, -1), "finishes": (1, -1, 1, 0),
    "overlapped-by": (1, -1, 1, 1), "met-by": (1, 0, 1, 1), "after": (1, 1, 1, 1),
}


def allen(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The relation of two intervals with start before end."""
    signs = [F.signum((x - y).cast("double")).cast("int") for x, y in ((a0, b0), (a0, b1), (a1, b0), (a1, b1))]
    out = None
    for name, want in ALLEN.items():
        hit = (signs[0] == want[0]) & (signs[1] == want[1]) & (signs[2] == want[2]) & (signs[3] == want[3])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def rcc8(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The region relation of two intervals."""
    inside, around = (a0 >= b0) & (a1 <= b1), (a0 <= b0) & (a1 >= b1)
    touching = (a0 == b0) | (a1 == b1)
    return (
        F.when((a1 < b0) | (b1 < a0), "DC").when((a1 == b0) | (b1 == a0), "EC").when(inside & around, "EQ")
        .when(inside, F.when(touching, "TPP").otherwise("NTPP")).when(around, F.when(touching, "TPPi").otherwise("NTPPi")).otherwise("PO")
    )


def rcc8_box(ax0: Column, ax1: Column, ay0: Column, ay1: Column, bx0: Column, bx1: Column, by0: Column, by1: Column) -> Column:
    """The region relation of two boxes, from those of their sides."""
    x, y = rcc8(ax0, ax1, bx0, bx1), rcc8(ay0, ay1, by0, by1)
    either = lambda *names: x.isin(*names) | y.isin(*names)
    both = lambda *names: x.isin(*names) & y.isin(*names)
    return (
        F.when(either("DC"), "DC").when(either("EC"), "EC").when(both("EQ"), "EQ")
        .when(both("EQ", "TPP", "NTPP"), F.when(both("NTPP"), "NTPP").otherwise("TPP"))
        .when(both("EQ", "TPPi", "NTPPi"), F.when(both("NTPPi"), "NTPPi").otherwise("TPPi")).otherwise("PO")
    )


def coarse(a0: Column, a1: Column, b0: Column, b1: Column, low: str, mid: str, high: str) -> Column:
    """Before, overlapping or after along one axis."""
    return F.when(a1 <= b0, low).when(b1 <= a0, high).otherwise(mid)


def interval_pairs(spark: SparkSession, n: int) -> DataFrame:
    """All intervals with bounds from -n to n."""
    ends = spark.range(-n, n + 1).select(F.col("id").cast("int").alias("x"))
    return ends.alias("p").join(ends.alias("q"), F.expr("p.x < q.x")).select(F.col("p.x").alias("s"), F.col("q.x").alias("e"))


def relation_table(spark: SparkSession, n: int) -> DataFrame:
    """(s1, e1, s2, e2, rel) of all pairs of small intervals; their number depends on n only."""
    i = interval_pairs(spark, n)
    both = i.select(F.col("s").alias("s1"), F.col("e").alias("e1")).crossJoin(i.select(F.col("s").alias("s2"), F.col("e").alias("e2")))
    return both.withColumn("rel", allen(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")))


def composition(spark: SparkSession, n: int = 3) -> DataFrame:
    """(r1, r2, r3): a r1 b and b r2 c allow a r3 c."""
    r = relation_table(spark, n)
    ab = r.select("s1", "e1", "s2", "e2", F.col("rel").alias("r1"))
    bc = r.select(F.col("s1").alias("s2"), F.col("e1").alias("e2"), F.col("s2").alias("s3"), F.col("e2").alias("e3"), F.col("rel").alias("r2"))
    abc = ab.join(bc, ["s2", "e2"])
    return abc.select("r1", "r2", allen(F.col("s1"), F.col("e1"), F.col("s3"), F.col("e3")).alias("r3")).distinct()


def converse(spark: SparkSession, n: int = 3) -> DataFrame:
    r = relation_table(spark, n)
    return r.select("rel", allen(F.col("s2"), F.col("e2"), F.col("s1"), F.col("e1")).alias("converse")).distinct()


def _refined(network: str, compose: dict[tuple[str, str], set[str]], inverse: dict[str, str]) -> list[tuple[int, int, str]]:
    facts = json.loads(network)
    nodes = sorted({n for f in facts for n in (f["i"], f["j"])})
    rel = {(i, j): set(ALLEN) if i != j else {"equals"} for i, j in product(nodes, nodes)}
    for f in facts:
        rel[f["i"], f["j"]] &= {f["rel"]}
        rel[f["j"], f["i"]] &= {inverse[f["rel"]]}
    changed = True
    while changed:
        changed = False
        for i, j, k in product(nodes, nodes, nodes):
            if i == k or j == k or i == j:
                continue
            allowed = set().union(*[compose[a, b] for a in rel[i, k] for b in rel[k, j]]) if rel[i, k] and rel[k, j] else set()
            if not rel[i, j] <= allowed:
                rel[i, j] &= allowed
                changed = True
    return [(i, j, ",".join(sorted(rel[i, j]))) for i in nodes for j in nodes if i < j]


def path_consistency(facts: DataFrame, table: list[tuple[str, str, str]]) -> DataFrame:
    """(grp, i, j, rels): what each pair can still be after refinement by composition; empty where inconsistent.

    Equal networks are refined once.  ``table`` are the 409 rows of the
    composition table.
    """
    compose: dict[tuple[str, str], set[str]] = {}
    for a, b, c in table:
        compose.setdefault((a, b), set()).add(c)
    inverse = {n: next(m for m, s in ALLEN.items() if s == (-w[0], -w[2], -w[1], -w[3])) for n, w in ALLEN.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(n, *r) for n in pdf["network"] for r in _refined(n, compose, inverse)], columns=["network", "i", "j", "rels"])

    networks = facts.groupBy("grp").agg(F.to_json(F.array_sort(F.collect_list(F.struct("i", "j", "rel")))).alias("network"))
    refined = networks.select("network").distinct().mapInPandas(run, "network string, i int, j int, rels string")
    return networks.join(refined, "network").select("grp", "i", "j", "rels")
