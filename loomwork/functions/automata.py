"""Regular expressions over a small alphabet, compared by partial derivatives."""

from __future__ import annotations

from functools import lru_cache

ALPHABET = "abcdefgh"


def parse(text: str) -> tuple:
    """Tree of a pattern with letters, . [] | * + ? and brackets."""
    at = 0

    def alt() -> tuple:
        nonlocal at
        out = seq()
        while at < len(text) and text[at] == "|":
            at += 1
            out = _alt(out, seq())
        return out

    def seq() -> tuple:
        nonlocal at
        out: tuple = ("e",)
        while at < len(text) and text[at] not in "|)":
            out = _cat(out, rep())
        return out

    def rep() -> tuple:
        nonlocal at
        one = atom()
        while at < len(text) and text[at] in "*+?":
            one = {"*": ("*", one), "+": _cat(one, ("*", one)), "?": _alt(one, ("e",))}[text[at]]
            at += 1
        return one

    def atom() -> tuple:
        nonlocal at
        c = text[at]
        at += 1
        if c == "(":
            out = alt()
            at += 1
            return out
        if c == "[":
            end = text.index("]", at)
            body, at = text[at:end], end + 1
            chars, i = set(), 0
            while i < len(body):
                if i + 2 < len(body) and body[i + 1] == "-":
                    chars |= {chr(x) for x in range(ord(body[i]), ord(body[i + 2]) + 1)}
                    i += 3
                else:
                    chars.add(body[i])
                    i += 1
            return ("c", frozenset(chars))
        return ("c", frozenset(ALPHABET if c == "." else c))

    return alt()


def _alt(a: tuple, b: tuple) -> tuple:
    if a == b or b == ("0",):
        return a
    return b if a == ("0",) else ("|", *sorted((a, b), key=repr))


def _cat(a: tuple, b: tuple) -> tuple:
    if ("0",) in (a, b):
        return ("0",)
    return b if a == ("e",) else a if b == ("e",) else (".", a, b)


@lru_cache(maxsize=100_000)
def empty(t: tuple) -> bool:
    """Whether the empty text matches."""
    return t[0] in ("e", "*") or (t[0] == "|" and (empty(t[1]) or empty(t[2]))) or (t[0] == "." and empty(t[1]) and empty(t[2]))


@lru_cache(maxsize=100_000)
def after(t: tuple, c: str) -> frozenset:
    """What may follow after the letter: patterns of which one must match, never more kinds than the pattern has letters."""
    if t[0] == "c":
        return frozenset([("e",)]) if c in t[1] else frozenset()
    if t[0] == "|":
        return after(t[1], c) | after(t[2], c)
    if t[0] == "*":
        return frozenset(_cat(x, t) for x in after(t[1], c))
    if t[0] == ".":
        first = frozenset(_cat(x, t[2]) for x in after(t[1], c))
        return first | after(t[2], c) if empty(t[1]) else first
    return frozenset()


def witness(left: str, right: str) -> str | None:
    """Shortest text, the first in order, that exactly one of the patterns matches; None where they are equal."""
    front = [("", frozenset([parse(left)]), frozenset([parse(right)]))]
    seen = {front[0][1:]}
    while front:
        grown = []
        for text, a, b in front:
            if any(map(empty, a)) != any(map(empty, b)):
                return text
            for c in ALPHABET:
                pair = frozenset(y for x in a for y in after(x, c)), frozenset(y for x in b for y in after(x, c))
                if pair not in seen:
                    seen.add(pair)
                    grown.append((text + c, *pair))
        front = grown
    return None
