"""Exact arithmetic, small interpreters and rewriting; used inside Arrow-batched functions."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from fractions import Fraction

_OPS: dict[type, Callable] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b,
    ast.FloorDiv: lambda a, b: Fraction(a // b), ast.Mod: lambda a, b: a % b,
}


def evaluate(text: str) -> Fraction | None:
    """Value of an arithmetic expression over decimals; None where it has none."""
    def walk(node: ast.AST) -> Fraction:
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -walk(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return Fraction(ast.get_source_segment(text, node) or str(node.value))
        raise ValueError("no arithmetic")

    try:
        return walk(ast.parse(text, mode="eval").body)
    except (ValueError, SyntaxError, ZeroDivisionError, RecursionError, MemoryError):
        return None


def as_decimal(value: Fraction | None, digits: int = 12) -> str | None:
    """Decimal text of a fraction that terminates within ``digits`` places."""
    if value is None:
        return None
    scaled = value * 10**digits
    if scaled.denominator != 1:
        return None
    sign, number = "-" if scaled < 0 else "", str(abs(scaled.numerator)).rjust(digits + 1, "0")
    whole, part = number[:-digits], number[-digits:].rstrip("0")
    return f"{sign}{whole}.{part}" if part else f"{sign}{whole}"


def solve(rows: list[list[int]], rhs: list[int]) -> list[Fraction] | str:
    """Solution of a linear system, or its class."""
    n = len(rows[0]) if rows else 0
    m = [[Fraction(x) for x in r] + [Fraction(b)] for r, b in zip(rows, rhs, strict=True)]
    at, pivots = 0, []
    for c in range(n):
        p = next((r for r in range(at, len(m)) if m[r][c]), None)
        if p is None:
            continue
        m[at], m[p] = m[p], m[at]
        m[at] = [x / m[at][c] for x in m[at]]
        for r in range(len(m)):
            if r != at and m[r][c]:
                m[r] = [x - m[r][c] * y for x, y in zip(m[r], m[at], strict=True)]
        pivots.append(c)
        at += 1
    if any(r[-1] and not any(r[:-1]) for r in m):
        return "inconsistent"
    return [m[i][-1] for i in range(n)] if len(pivots) == n else "underdetermined"


# terms: variables are lower-case words with a question mark before, the rest are constants and functions
_TERM = re.compile(r"\s*([?\w']+|[(),])")


def parse_term(text: str) -> tuple:
    """A first-order term as (head, arguments)."""
    tokens, at = _TERM.findall(text), 0

    def term() -> tuple:
        nonlocal at
        head = tokens[at]
        at += 1
        args = []
        if at < len(tokens) and tokens[at] == "(":
            at += 1
            while tokens[at] != ")":
                args.append(term())
                if tokens[at] == ",":
                    at += 1
            at += 1
        return (head, tuple(args))

    return term()


def show_term(t: tuple) -> str:
    return t[0] + (f"({','.join(map(show_term, t[1]))})" if t[1] else "")


def unify(left: str, right: str) -> dict[str, str] | None:
    """The most general unifier with its bindings resolved; None where there is none."""
    bound: dict[str, tuple] = {}

    def walk(t: tuple) -> tuple:
        while t[0].startswith("?") and t[0] in bound:
            t = bound[t[0]]
        return t

    def resolve(t: tuple) -> tuple:
        t = walk(t)
        return (t[0], tuple(resolve(a) for a in t[1]))

    def occurs(name: str, t: tuple) -> bool:
        t = walk(t)
        return t[0] == name or any(occurs(name, a) for a in t[1])

    todo = [(parse_term(left), parse_term(right))]
    while todo:
        a, b = (walk(x) for x in todo.pop())
        if a == b:
            continue
        if not a[0].startswith("?") and b[0].startswith("?"):
            a, b = b, a
        if a[0].startswith("?"):
            if occurs(a[0], b):
                return None
            bound[a[0]] = b
        elif a[0] != b[0] or len(a[1]) != len(b[1]):
            return None
        else:
            todo += zip(a[1], b[1], strict=True)
    return {k: show_term(resolve((k, ()))) for k in sorted(bound)}


# lambda terms as ("v", name), ("l", name, body), ("a", function, argument)
def parse_lambda(text: str) -> tuple:
    r"""``\x.body``, application by juxtaposition."""
    tokens, at = re.findall(r"\\\w+\.|\w+|[()]", text), 0

    def expr() -> tuple:
        nonlocal at
        out = None
        while at < len(tokens) and tokens[at] != ")":
            tok = tokens[at]
            at += 1
            if tok[0] == "\\":
                one = ("l", tok[1:-1], expr())
            elif tok == "(":
                one = expr()
                at += 1
            else:
                one = ("v", tok)
            out = one if out is None else ("a", out, one)
        return out

    return expr()


def de_bruijn(t: tuple, bound: tuple[str, ...] = ()) -> str:
    """Text that terms share which differ in the names of bound variables only."""
    if t[0] == "v":
        return str(bound.index(t[1])) if t[1] in bound else t[1]
    if t[0] == "l":
        return f"(L {de_bruijn(t[2], (t[1], *bound))})"
    return f"({de_bruijn(t[1], bound)} {de_bruijn(t[2], bound)})"


def _free(t: tuple) -> set[str]:
    return {t[1]} if t[0] == "v" else _free(t[2]) - {t[1]} if t[0] == "l" else _free(t[1]) | _free(t[2])


def _substitute(t: tuple, name: str, by: tuple) -> tuple:
    if t[0] == "v":
        return by if t[1] == name else t
    if t[0] == "a":
        return ("a", _substitute(t[1], name, by), _substitute(t[2], name, by))
    if t[1] == name:
        return t
    own, body = t[1], t[2]
    if own in _free(by):
        fresh = own
        while fresh in _free(by) | _free(body):
            fresh += "'"
        own, body = fresh, _substitute(body, t[1], ("v", fresh))
    return ("l", own, _substitute(body, name, by))


def beta(t: tuple, steps: int = 200) -> tuple | None:
    """Normal form by leftmost-outermost reduction; None where it isn't reached."""
    def step(t: tuple) -> tuple | None:
        if t[0] == "a":
            if t[1][0] == "l":
                return _substitute(t[1][2], t[1][1], t[2])
            inner = step(t[1])
            if inner is not None:
                return ("a", inner, t[2])
            inner = step(t[2])
            return None if inner is None else ("a", t[1], inner)
        if t[0] == "l":
            inner = step(t[2])
            return None if inner is None else ("l", t[1], inner)
        return None

    for _ in range(steps):
        after = step(t)
        if after is None:
            return t
        t = after
    return None
