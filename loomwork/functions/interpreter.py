"""Runs small programs without handing them to Python: only what is listed here can happen.

Numbers, texts, truth values, assignments, ``if``, ``while``, ``for`` over
``range``, ``print`` and a few functions.  There are no attributes, imports,
definitions or other names.  A program ends after ``fuel`` steps at the latest
and then, as after any error, has no output.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Div: operator.truediv}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_CALLS: dict[str, Callable] = {"abs": abs, "len": len, "min": min, "max": max, "str": str, "int": int, "range": range}
#: Largest number of bits of a whole number, and of signs of a text.
_LARGEST = 4096


class Refused(Exception):
    """The program uses something that isn't listed."""


class _Run:
    def __init__(self, fuel: int) -> None:
        self.fuel, self.names, self.out = fuel, {}, []

    def spend(self) -> None:
        self.fuel -= 1
        if self.fuel < 0:
            raise Refused("out of fuel")

    def value(self, e: ast.expr):
        self.spend()
        match e:
            case ast.Constant(value=int() | str() | bool() | float()):
                return e.value
            case ast.Name(id=name) if name in self.names:
                return self.names[name]
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                x, y = self.value(a), self.value(b)
                text, times = (x, y) if isinstance(x, str) else (y, x)
                if isinstance(op, ast.Mult) and isinstance(text, str) and isinstance(times, int) and len(text) * times > _LARGEST:
                    raise Refused("too long a text")
                if isinstance(op, ast.Mod) and isinstance(x, str):
                    raise Refused("formatting")
                return self.bounded(_BINARY[type(op)](x, y))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -self.value(a)
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return not self.value(a)
            case ast.BoolOp(op=op, values=parts):
                out = None
                for p in parts:
                    out = self.value(p)
                    if bool(out) != isinstance(op, ast.And):
                        break
                return out
            case ast.Compare(left=a, ops=ops, comparators=rest) if all(type(o) in _COMPARE for o in ops):
                left = self.value(a)
                for op, b in zip(ops, rest, strict=True):
                    right = self.value(b)
                    if not _COMPARE[type(op)](left, right):
                        return False
                    left = right
                return True
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
                return self.bounded(_CALLS[name](*[self.value(a) for a in args]))
        raise Refused(type(e).__name__)

    @staticmethod
    def bounded(x):
        if isinstance(x, int) and x.bit_length() > _LARGEST or isinstance(x, str) and len(x) > _LARGEST:
            raise Refused("too large")
        return x

    def body(self, statements: list[ast.stmt]) -> None:
        for s in statements:
            self.spend()
            match s:
                case ast.Assign(targets=[ast.Name(id=name)], value=e):
                    self.names[name] = self.value(e)
                case ast.AugAssign(target=ast.Name(id=name), op=op, value=e) if name in self.names:
                    self.names[name] = self.value(ast.BinOp(left=ast.Name(id=name), op=op, right=e))
                case ast.If(test=test, body=yes, orelse=no):
                    self.body(yes if self.value(test) else no)
                case ast.While(test=test, body=inner, orelse=[]):
                    while self.value(test):
                        self.body(inner)
                case ast.For(target=ast.Name(id=name), iter=ast.Call(func=ast.Name(id="range"), args=args, keywords=[]), body=inner, orelse=[]):
                    for i in range(*[self.value(a) for a in args]):
                        self.names[name] = i
                        self.spend()
                        self.body(inner)
                case ast.Expr(value=ast.Call(func=ast.Name(id="print"), args=args, keywords=[])):
                    self.out.append(" ".join(str(self.value(a)) for a in args))
                case ast.Pass():
                    pass
                case _:
                    raise Refused(type(s).__name__)


def run(code: str, fuel: int = 100_000) -> str | None:
    """What a program prints, without white space at its ends; None if it fails, is refused or doesn't end."""
    try:
        state = _Run(fuel)
        state.body(ast.parse(code).body)
    except (Refused, SyntaxError, ValueError, TypeError, ArithmeticError, RecursionError, MemoryError, KeyError):
        return None
    return "\n".join(state.out).strip()
