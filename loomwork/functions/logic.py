"""Formulas over a few truth values, as sets of worlds: bit w of a mask says whether the formula holds in world w."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(<=>|=>|[()~&|]|[a-z]\w*)")


def worlds_of(i: int, n: int) -> int:
    """The worlds in which variable ``i`` of ``n`` is true."""
    return sum(1 << w for w in range(1 << n) if w >> i & 1)


def mask(text: str, names: list[str]) -> int:
    """The worlds of a formula with ~ & | => <=> and brackets, binding in this order."""
    n = len(names)
    every = (1 << (1 << n)) - 1
    tokens = _TOKEN.findall(text)
    if "".join(tokens) != re.sub(r"\s", "", text):
        raise ValueError(f"no formula: {text!r}")
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(expected: str = "") -> str:
        nonlocal at
        got = peek()
        if not got or expected and got != expected:
            raise ValueError(f"no formula: {text!r}")
        at += 1
        return got

    def iff() -> int:
        out = implies()
        while peek() == "<=>":
            take()
            out = every & ~(out ^ implies())
        return out

    def implies() -> int:
        left = either()
        if peek() == "=>":
            take()
            return (every & ~left) | implies()
        return left

    def either() -> int:
        out = both()
        while peek() == "|":
            take()
            out |= both()
        return out

    def both() -> int:
        out = one()
        while peek() == "&":
            take()
            out &= one()
        return out

    def one() -> int:
        if peek() == "~":
            take()
            return every & ~one()
        if peek() == "(":
            take()
            out = iff()
            take(")")
            return out
        return worlds_of(names.index(take()), n)

    out = iff()
    if at < len(tokens):
        raise ValueError(f"no formula: {text!r}")
    return out


def clause_mask(literals: Column, n: int) -> Column:
    """The worlds of a clause; literals are numbers from 1, negative where negated."""
    every = (1 << (1 << n)) - 1
    of = F.array(*[F.lit(worlds_of(i, n)).cast("long") for i in range(n)])
    one = lambda x: F.when(x > 0, F.element_at(of, F.abs(x))).otherwise(F.bitwise_not(F.element_at(of, F.abs(x))).bitwiseAND(F.lit(every).cast("long")))
    return F.aggregate(literals, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(one(x)))


def all_of(masks: Column, n: int) -> Column:
    """The worlds in which all hold."""
    return F.aggregate(masks, F.lit((1 << (1 << n)) - 1).cast("long"), lambda acc, m: acc.bitwiseAND(m))


def relation(premises: Column, hypothesis: Column, n: int) -> Column:
    """What premises say of a hypothesis: entailment, contradiction, neutral, or paradox where they can't hold."""
    every = F.lit((1 << (1 << n)) - 1).cast("long")
    with_it = premises.bitwiseAND(hypothesis) != 0
    without = premises.bitwiseAND(F.bitwise_not(hypothesis)).bitwiseAND(every) != 0
    return F.when(with_it & ~without, "entailment").when(with_it & without, "neutral").when(~with_it & without, "contradiction").otherwise("paradox")


def minimal_premises(masks: list[int], hypothesis: int, n: int) -> list[int] | None:
    """Numbers of the fewest premises that entail a hypothesis, of several sets the first; None if all of them don't."""
    from itertools import combinations

    every = (1 << (1 << n)) - 1
    for size in range(len(masks) + 1):
        for some in combinations(range(len(masks)), size):
            left = every
            for i in some:
                left &= masks[i]
            if not left & ~hypothesis & every:
                return list(some)
    return None
