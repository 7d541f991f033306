"""Finite constraint problems, a row each, solved side by side in Arrow batches.

A problem has an upper bound for each variable and constraints over some of
them: ``lin`` (a weighted sum against a number), ``mod`` (a weighted sum modulo
a number) and ``alldiff``.  Variables are given values one after the other; a
constraint is tested as soon as its last variable has one, so most partial
assignments never grow.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.scratch import materialise

CONSTRAINT = "struct<kind string, idx array<int>, coeffs array<int>, op string, rhs int, mod int>"


def holds(c: Column, x: Column) -> Column:
    """Whether an assignment of all its variables meets a constraint."""
    picked = F.transform(c["idx"], lambda i: F.element_at(x, i + 1))
    total = F.aggregate(F.zip_with(c["coeffs"], picked, lambda a, v: a * v), F.lit(0), lambda acc, v: acc + v)
    lin = F.when(c["op"] == "==", total == c["rhs"]).when(c["op"] == "!=", total != c["rhs"]).when(c["op"] == "<=", total <= c["rhs"]).otherwise(total >= c["rhs"])
    return F.when(c["kind"] == "lin", lin).when(c["kind"] == "mod", F.pmod(total, c["mod"]) == c["rhs"]).otherwise(F.size(F.array_distinct(picked)) == F.size(picked))


def solve(bounds: list[int], constraints: list[dict]) -> np.ndarray:
    """All solutions of a problem in order, a row each."""
    grown = np.zeros((1, 0), np.int64)
    for k, most in enumerate(bounds):
        n = len(grown)
        grown = np.hstack([np.repeat(grown, most + 1, axis=0), np.tile(np.arange(most + 1), n)[:, None]])
        for c in constraints:
            if max(c["idx"]) != k:
                continue
            picked = grown[:, c["idx"]]
            if c["kind"] == "alldiff":
                ordered = np.sort(picked, axis=1)
                kept = (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            else:
                total = picked @ np.array(c["coeffs"], np.int64)
                kept = total % c["mod"] == c["rhs"] if c["kind"] == "mod" else _COMPARE[c["op"]](total, c["rhs"])
            grown = grown[kept]
    return grown


#: Comparisons of linear constraints; fixed values.
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<=": operator.le, ">=": operator.ge}


def solutions(problems: DataFrame) -> DataFrame:
    """(id, x) of every solution of problems (id, bounds, constraints), a batch of rows for each problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (bounds, given) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = solve(bounds, given or [])
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                x = pa.ListArray.from_arrays(ends, pa.array(found.ravel().astype(np.int32)))
                yield pa.record_batch([batch.column(0).take(pa.array(np.full(len(found), i))), x], names=["id", "x"])

    kind = problems.schema["id"].dataType.simpleString()
    return problems.select("id", "bounds", "constraints").mapInArrow(run, f"id {kind}, x array<int>")


def answers(problems: DataFrame, cap: int = 256) -> DataFrame:
    """(id, mode, n, first, answer): all solutions in order, only the least where there are more than ``cap``, or UNSAT.

    The cap is the feature: what is asked for changes when solutions are many.
    No more of them are ever brought together than that.
    """
    # read three times, and dear to find
    found = materialise(solutions(problems), "solutions").withColumn("text", F.concat_ws(",", F.transform("x", lambda v: v.cast("string"))))
    per = found.groupBy("id").agg(F.count("*").alias("n"), F.min("x").alias("first"))
    few = found.join(per.filter(F.col("n") <= cap).select("id"), "id", "left_semi").groupBy("id").agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"])).alias("all"))
    out = problems.select("id").join(per, "id", "left").join(few, "id", "left")
    first = F.concat_ws(",", F.transform("first", lambda v: v.cast("string")))
    mode = F.when(F.col("n").isNull(), "UNSAT").when(F.col("n") > cap, "min").otherwise("all")
    return out.select("id", mode.alias("mode"), F.coalesce("n", F.lit(0)).alias("n"), F.when(mode == "UNSAT", "UNSAT").when(mode == "min", first).otherwise(F.col("all")).alias("answer"))


def constraint_text(c: Column) -> Column:
    """A constraint as it is written: ``2*x0 - x1 <= 3``, ``(x0 + 2*x2) % 3 == 1``, ``AllDifferent(x0, x1)``."""
    name = lambda i: F.concat(F.lit("x"), i.cast("string"))
    term = lambda a, i: F.when(a == 1, name(i)).when(a == -1, F.concat(F.lit("-"), name(i))).otherwise(F.concat(a.cast("string"), F.lit("*"), name(i)))
    total = F.replace(F.concat_ws(" + ", F.zip_with(c["coeffs"], c["idx"], term)), F.lit("+ -"), F.lit("- "))
    lin = F.concat_ws(" ", total, c["op"], c["rhs"].cast("string"))
    mod = F.concat(F.lit("("), total, F.lit(") % "), c["mod"].cast("string"), F.lit(" == "), c["rhs"].cast("string"))
    return F.when(c["kind"] == "lin", lin).when(c["kind"] == "mod", mod).otherwise(F.concat(F.lit("AllDifferent("), F.concat_ws(", ", F.transform(c["idx"], name)), F.lit(")")))
