"""Planning over tables of ground STRIPS problems.

A state is a number whose bits are the facts that hold.  An action needs the
facts of ``pre``, none of ``neg``, and then sets ``add`` and clears ``del``.
A problem is one row with its own actions, so problems are planned side by
side whatever their number; a search goes breadth first through the states of
its own problem and ends at the goal or when no new state is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a step costs besides the number of its action: fewer steps always win.
STEP_COST = 10_000
ACTION = "struct<no int, pre long, neg long, add long, del long>"


def search(init: int, want: int, avoid: int, actions: list[tuple[int, int, int, int, int]]) -> tuple[int, tuple[int, ...]] | None:
    """The cheapest plan as (cost, numbers of the actions), of equal ones the first in order; None if there is none."""
    level: dict[int, tuple[int, tuple[int, ...]]] = {init: (0, ())}
    seen: set[int] = set()
    while level:
        done = [found for state, found in level.items() if state & want == want and not state & avoid]
        if done:
            return min(done)
        seen.update(level)
        after: dict[int, tuple[int, tuple[int, ...]]] = {}
        for state, (cost, plan) in level.items():
            for no, pre, neg, add, clear in actions:
                if state & pre == pre and not state & neg:
                    to = state & ~clear | add
                    if to not in seen:
                        found = (cost + STEP_COST + no, (*plan, no))
                        if to not in after or found < after[to]:
                            after[to] = found
        level = after
    return None


def plans(problems: DataFrame) -> DataFrame:
    """(id, cost, plan) of problems (id, init, want, avoid, actions); both null where the goal can't be reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for init, want, avoid, actions in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                own = [(a["no"], a["pre"], a["neg"], a["add"], a["del"]) for a in actions or []]
                found.append(search(init, want, avoid, own) or (None, None))
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["id", "cost", "plan"])

    kind = problems.schema["id"].dataType.simpleString()
    return problems.select("id", "init", "want", "avoid", "actions").mapInArrow(run, f"id {kind}, cost long, plan array<int>")


def states_along(init: Column, steps: Column) -> Column:
    """(state, ok) after the steps, an array of actions: ok while each was allowed where it was taken."""
    one = lambda s, a: F.struct(
        s["state"].bitwiseAND(F.bitwise_not(a["del"])).bitwiseOR(a["add"]).alias("state"),
        (s["ok"] & (s["state"].bitwiseAND(a["pre"]) == a["pre"]) & (s["state"].bitwiseAND(a["neg"]) == 0)).alias("ok"),
    )
    return F.aggregate(steps, F.struct(init.cast("long").alias("state"), F.lit(True).alias("ok")), one)


def plan_score(init: Column, want: Column, avoid: Column, steps: Column) -> Column:
    """1 for a plan that can be carried out and reaches the goal, a tenth for another one, 0 for none or one with unknown actions."""
    end = states_along(init, steps)
    good = end["ok"] & (end["state"].bitwiseAND(want) == want) & (end["state"].bitwiseAND(avoid) == 0)
    readable = F.size(steps) > 0
    return F.when(~F.coalesce(readable, F.lit(False)) | F.exists(steps, lambda a: a.isNull()), 0.0).when(good, 1.0).otherwise(0.1)


def without_negative(actions: DataFrame, facts: int) -> DataFrame:
    """Actions (…, pre, neg, add, del) whose negative conditions are conditions on complementary facts, ``facts`` bits higher."""
    up = lambda c: F.shiftleft(F.col(c), facts)
    return actions.withColumns({
        "pre": F.col("pre").bitwiseOR(up("neg")),
        "neg": F.lit(0).cast("long"),
        "add": F.col("add").bitwiseOR(up("del")),
        "del": F.col("del").bitwiseOR(up("add")),
    })
