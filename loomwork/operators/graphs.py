"""Graphs as edge tables: reachability, paths, degrees, orders."""

from __future__ import annotations

import functools
import heapq
import itertools
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.scratch import materialise


#: Parts of a table that grows round by round before they are put together.
PARTS = 16


class Grown:
    """A table that gets a part a round; parts are written once and only put together when there are many."""

    def __init__(self, first: DataFrame, name: str) -> None:
        self.parts, self.name = [first], name

    def all(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, self.parts)

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > PARTS:
            self.parts = [materialise(self.all(), self.name)]


def closure(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(u, v, hops): v can be reached from u, in at most ``rounds`` steps if given; semi-naive, one step further a round."""
    front = materialise(edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL").distinct(), "closure")
    step = front.select(F.col("u").alias("v"), F.col("v").alias("w"))
    known = Grown(front.withColumn("hops", F.lit(1)), "closure")
    for i in itertools.count(2) if rounds is None else range(2, rounds + 1):
        reached = front.join(step, "v").select("u", F.col("w").alias("v")).distinct()
        front = materialise(reached.join(known.all().select("u", "v"), ["u", "v"], "left_anti"), "closure")
        if front.isEmpty():
            break
        known.add(front.withColumn("hops", F.lit(i)))
    return known.all()


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """(source, node, path): of the shortest paths, of at most ``rounds`` steps if given, the first in order, nodes as numbers in an array."""
    step = materialise(edges.select(F.col("u").alias("node"), F.col("v").alias("next")).distinct(), "steps")
    front = materialise(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("path", F.array("node")), "paths")
    known = Grown(front, "paths")
    for _ in itertools.count() if rounds is None else range(rounds):
        grown = front.join(step, "node").select("source", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        best = grown.groupBy("source", "node").agg(F.min("path").alias("path"))
        front = materialise(best.join(known.all().select("source", "node"), ["source", "node"], "left_anti"), "paths")
        if front.isEmpty():
            break
        known.add(front)
    return known.all()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges in and out; a loop counts twice."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def most_central(edges: DataFrame) -> DataFrame:
    """All nodes of the highest degree."""
    d = degrees(edges)
    return d.join(F.broadcast(d.agg(F.max("degree").alias("degree"))), "degree").select("node", "degree")


def successor_after(mapping: DataFrame, k: int) -> DataFrame:
    """(u, v): where k steps of a function lead, by doubling: log2(k) self-joins."""
    power, out, first = mapping.select("u", "v"), None, True
    while k:
        if k & 1:
            out = power if out is None else out.join(power.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v"))
        k >>= 1
        if k:
            power = power.join(power.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v"))
            power = power if first else materialise(power, "power")
            first = False
    return out


def topological_orders(edges: DataFrame, group: str) -> DataFrame:
    """(group, order): of the topological orders of each graph the one that always takes the smallest free node."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        after, need = defaultdict(set), defaultdict(int)
        for u, v in zip(pdf["u"], pdf["v"], strict=True):
            if v not in after[u]:
                after[u].add(v)
                need[v] += 1
            need[u] += 0
        free = [n for n, k in need.items() if not k]
        heapq.heapify(free)
        out = []
        while free:
            u = heapq.heappop(free)
            out.append(u)
            for v in after[u]:
                need[v] -= 1
                if not need[v]:
                    heapq.heappush(free, v)
        done = ",".join(map(str, out)) if len(out) == len(need) else None
        return pd.DataFrame({group: [pdf[group].iloc[0]], "topo": [done]})

    kind = dict(edges.dtypes)[group]
    return edges.select(group, "u", "v").groupBy(group).applyInPandas(order, f"{group} {kind}, topo string")


def check_paths(paths: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, valid, steps): whether all consecutive nodes of ``path`` are joined by edges."""
    hops = paths.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("u"), F.element_at("path", i + 1).alias("v")))).alias("h")).select(key, "h.u", "h.v")
    found = hops.join(edges.select("u", "v").distinct().withColumn("_there", F.lit(True)), ["u", "v"], "left")
    return found.groupBy(key).agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("valid"), F.count("*").alias("steps"))


def refine_colours(edges: DataFrame, group: str, rounds: int = 3) -> DataFrame:
    """(group, colours): a fingerprint that isomorphic graphs share, by colour refinement."""
    both = edges.select(group, F.col("u").alias("a"), F.col("v").alias("b"), F.lit("out").alias("way")).unionByName(edges.select(group, F.col("v").alias("a"), F.col("u").alias("b"), F.lit("in").alias("way")))
    colour = both.groupBy(group, "a").agg(F.xxhash64(F.count_if(F.col("way") == "out"), F.count_if(F.col("way") == "in")).alias("c"))
    for _ in range(rounds):
        near = both.join(colour.select(group, F.col("a").alias("b"), "c"), [group, "b"]).groupBy(group, "a").agg(F.array_sort(F.collect_list(F.struct("way", "c"))).alias("n"))
        colour = materialise(near.join(colour, [group, "a"]).select(group, "a", F.xxhash64("c", F.to_json("n")).alias("c")), "colours")
    return colour.groupBy(group).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")).alias("colours"))


def adjacency_text(edges: DataFrame) -> DataFrame:
    """(u, line): "u: v, w" for every node with edges out."""
    return edges.groupBy("u").agg(F.concat(F.col("u").cast("string"), F.lit(": "), F.array_join(F.transform(F.array_sort(F.collect_set("v")), lambda v: v.cast("string")), ", ")).alias("line"))


def farthest(distances: DataFrame) -> DataFrame:
    """The pair farthest apart; of several the first in order."""
    return distances.orderBy(F.desc("hops"), "u", "v").limit(1)


def roots_above(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """(v, u): of the ancestors u of v those that nothing leads to."""
    return reach.select("u", "v").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_anti")


def rank_in(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order)))
