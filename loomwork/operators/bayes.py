"""Inference in tables of Bayesian networks by eliminating variables.

A network is one row: for each variable its parents and the table of its
distribution.  Networks are small and many, so each is worked through in its
task, in Arrow batches.  A factor is a tuple of variables and a NumPy array
with an axis for each.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "struct<var int, parents array<int>, states int, p array<double>>"
Factor = tuple[tuple[int, ...], np.ndarray]


@dataclass
class Network:
    """Variables with parents; ``p[v]`` has an axis for each parent and the last for the variable."""

    parents: dict[int, tuple[int, ...]]
    p: dict[int, np.ndarray]
    trace: list[str] = field(default_factory=list)

    @staticmethod
    def of(nodes: list[dict]) -> Network:
        states = {n["var"]: n["states"] for n in nodes}
        shape = lambda n: [*[states[q] for q in n["parents"]], n["states"]]
        return Network({n["var"]: tuple(n["parents"]) for n in nodes}, {n["var"]: np.array(n["p"], float).reshape(shape(n)) for n in nodes})

    def factors(self) -> list[Factor]:
        return [((*self.parents[v], v), self.p[v]) for v in sorted(self.parents)]

    def do(self, var: int, state: int) -> Network:
        """The network after ``var`` is set from outside: its edges from parents fall away, it is certain."""
        point = np.zeros(self.p[var].shape[-1])
        point[state] = 1.0
        return Network({**self.parents, var: ()}, {**self.p, var: point})


def multiply(a: Factor, b: Factor) -> Factor:
    """Product of two factors over the union of their variables."""
    names = tuple(sorted(set(a[0]) | set(b[0])))
    return names, np.einsum(a[1], [names.index(v) for v in a[0]], b[1], [names.index(v) for v in b[0]], range(len(names)))


def sum_out(f: Factor, var: int) -> Factor:
    return tuple(v for v in f[0] if v != var), f[1].sum(axis=f[0].index(var))


def reduce(f: Factor, evidence: dict[int, int]) -> Factor:
    """The part of a factor that agrees with the evidence."""
    at = tuple(evidence.get(v, slice(None)) for v in f[0])
    return tuple(v for v in f[0] if v not in evidence), f[1][at]


def min_fill(scopes: list[tuple[int, ...]], keep: set[int]) -> list[int]:
    """An order that asks for the fewest new edges at each step, of equal variables the first."""
    near: dict[int, set[int]] = {}
    for scope in scopes:
        for v in scope:
            near.setdefault(v, set()).update(set(scope) - {v})
    order = []
    left = set(near) - keep
    while left:
        fill = lambda v: sum(b not in near[a] for a, b in itertools.combinations(sorted(near[v]), 2))
        best = min(sorted(left), key=fill)
        for a in near[best]:
            near[a] |= near[best] - {a}
            near[a].discard(best)
        left.discard(best)
        del near[best]
        order.append(best)
    return order


def posterior(net: Network, target: int, evidence: dict[int, int], say: Callable[[str], None] = lambda line: None) -> np.ndarray | None:
    """P(target | evidence); None where the evidence can't happen.  ``say`` hears each step."""
    named = lambda scope: ", ".join(f"X{v}" for v in scope)
    factors = [reduce(f, evidence) for f in net.factors()]
    if evidence:
        say("given " + ", ".join(f"X{v}={s}" for v, s in sorted(evidence.items())))
    order = min_fill([f[0] for f in factors], {target})
    for var in order:
        own = [f for f in factors if var in f[0]]
        product = own[0]
        for f in own[1:]:
            product = multiply(product, f)
        after = sum_out(product, var)
        say(f"sum out X{var} of {len(own)} over ({named(product[0])}), leaving ({named(after[0])})")
        factors = [f for f in factors if var not in f[0]] + [after]
    out: Factor = ((target,), np.ones(net.p[target].shape[-1]))
    for f in factors:
        out = multiply(out, f)
    total = out[1].sum()
    if not total:
        say("the evidence is impossible")
        return None
    say("P(X%d) = %s" % (target, ", ".join(f"{x:.6f}" for x in out[1] / total)))
    return out[1] / total


def queries_answered(questions: DataFrame) -> DataFrame:
    """(id, p, elimination, proof) of questions (id, nodes, target, given, given_state, set, set_state); null where nothing is given or set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, orders, proofs = [], [], []
            for nodes, target, given, state, var, value in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                net, lines = Network.of(nodes), []
                if var is not None:
                    net = net.do(var, value)
                    lines.append(f"set X{var}={value}")
                found = posterior(net, target, {} if given is None else {given: state}, lines.append)
                p.append(None if found is None else found.tolist())
                orders.append([int(x) for line in lines for x in re.findall(r"^sum out X(\d+)", line)])
                proofs.append("\n".join(lines))
            yield pa.record_batch([batch.column(0), pa.array(p, pa.list_(pa.float64())), pa.array(orders, pa.list_(pa.int32())), pa.array(proofs, pa.string())], names=["id", "p", "elimination", "proof"])

    return questions.select("id", "nodes", "target", "given", "given_state", "set", "set_state").mapInArrow(run, "id long, p array<double>, elimination array<int>, proof string")


def as_noisy_or(p: np.ndarray, eps: float = 1e-9) -> tuple[float, list[float]] | None:
    """Leak and strengths of binary parents if the table is a noisy OR, else None."""
    if p.ndim < 2 or any(n != 2 for n in p.shape):
        return None
    off = p[..., 0]
    k = off.ndim
    none = float(off[(0,) * k])
    if none <= 0:
        return None
    strength = [1 - float(off[tuple(int(i == j) for j in range(k))]) / none for i in range(k)]
    for at in itertools.product((0, 1), repeat=k):
        if abs(float(off[at]) - none * float(np.prod([1 - s for s, a in zip(strength, at, strict=True) if a]))) > eps:
            return None
    return 1 - none, strength


def compact(networks: DataFrame, gain: float = 0.0) -> DataFrame:
    """(id, var, leak, strengths): the tables of networks (id, nodes) that are a noisy OR and shrink by more than ``gain``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                net = Network.of(nodes)
                for v in sorted(net.parents):
                    found = as_noisy_or(net.p[v])
                    if found and 1 - (len(found[1]) + 1) / net.p[v][..., 0].size > gain:
                        rows.append((key, v, *found))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64())], strict=True)], names=["id", "var", "leak", "strengths"])

    return networks.select("id", "nodes").mapInArrow(run, "id long, var int, leak double, strengths array<double>")


def write_bif(nodes: list[dict]) -> str:
    """A network in the interchange format for Bayesian networks."""
    states = {n["var"]: n["states"] for n in nodes}
    out = ["network unknown {", "}"]
    for n in nodes:
        out.append(f"variable X{n['var']} {{\n  type discrete [ {n['states']} ] {{ {', '.join(str(s) for s in range(n['states']))} }};\n}}")
    for n in nodes:
        rows = np.array(n["p"]).reshape(-1, n["states"])
        given = " | " + ", ".join(f"X{q}" for q in n["parents"]) if n["parents"] else ""
        lines = []
        for at, row in zip(itertools.product(*[range(states[q]) for q in n["parents"]]), rows, strict=True):
            head = f"({', '.join(map(str, at))}) " if at else "table "
            lines.append(f"  {head}{', '.join(repr(float(x)) for x in row)};")
        out.append(f"probability ( X{n['var']}{given} ) {{\n" + "\n".join(lines) + "\n}")
    return "\n".join(out) + "\n"


_VARIABLE = re.compile(r"variable\s+X(\d+)\s*\{\s*type\s+discrete\s*\[\s*(\d+)\s*\]")
_TABLE = re.compile(r"probability\s*\(\s*X(\d+)\s*(?:\|\s*([^)]*?)\s*)?\)\s*\{([^}]*)\}")
_ROW = re.compile(r"(?:table|\(([^)]*)\))\s*([^;]*);")


def read_bif(text: str) -> list[dict]:
    """The nodes of a network in that format; rows may come in any order."""
    states = {int(v): int(n) for v, n in _VARIABLE.findall(text)}
    out = []
    for var, given, body in _TABLE.findall(text):
        parents = [int(q.strip().removeprefix("X")) for q in given.split(",")] if given else []
        p = np.zeros([*[states[q] for q in parents], states[int(var)]])
        for at, row in _ROW.findall(body):
            p[tuple(int(x) for x in at.split(",")) if at else ()] = [float(x) for x in row.split(",")]
        out.append({"var": int(var), "parents": parents, "states": states[int(var)], "p": p.ravel().tolist()})
    return out


def collect_nodes(rows: DataFrame) -> DataFrame:
    """Networks (id, nodes) of rows (id, var, parents, states, p)."""
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("var", "parents", "states", "p"))).alias("nodes"))
