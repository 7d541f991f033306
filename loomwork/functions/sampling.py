"""Grammars as input: trees, samples, and smaller grammars; each choice depends on a seed only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from loomwork.functions import grammar as cfg

Grammar = dict[str, list[tuple[str, ...]]]


def choices(seed: str) -> Iterator[int]:
    """Numbers below 2**32, one after the other."""
    k = 0
    while True:
        yield int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16)
        k += 1


def cheapest(grammar: Grammar) -> dict[str, int]:
    """Least depth of a tree below each productive symbol."""
    depth: dict[str, int] = {}
    while True:
        after = dict(depth)
        for head, bodies in grammar.items():
            costs = [1 + max((0 if s not in grammar else depth[s] for s in b), default=0) for b in bodies if all(s not in grammar or s in depth for s in b)]
            if costs:
                after[head] = min(costs)
        if after == depth:
            return depth
        depth = after


def sample(grammar: Grammar, start: str, seed: str, deepest: int = 8) -> list[str] | None:
    """A sentence; below ``deepest`` only rules that end soonest are taken.  None if there is no sentence."""
    least = cheapest(grammar)
    if start not in least:
        return None
    pick, out = choices(seed), []
    todo: list[tuple[str, int]] = [(start, 0)]
    while todo:
        symbol, depth = todo.pop()
        if symbol not in grammar:
            out.append(symbol)
            continue
        cost = lambda b: 1 + max((0 if s not in grammar else least[s] for s in b), default=0)
        able = [b for b in grammar[symbol] if all(s not in grammar or s in least for s in b)]
        if depth >= deepest:
            able = [b for b in able if cost(b) == min(map(cost, able))]
        body = able[next(pick) % len(able)]
        todo += [(s, depth + 1) for s in reversed(body)]
    return out


def trees(grammar: Grammar, start: str, tokens: list[str], most: int = 2) -> list[str]:
    """Up to ``most`` parse trees as nested brackets: ``(S (A a) b)``; grammars without empty or circular rules."""
    memo: dict = {}

    def symbol(s: str, i: int, j: int) -> list[str]:
        if s not in grammar:
            return [s] if j == i + 1 and tokens[i] == s else []
        if (s, i, j) not in memo:
            memo[s, i, j] = []
            memo[s, i, j] = [f"({s} {t})" for b in grammar[s] for t in body(b, i, j)][:most]
        return memo[s, i, j]

    def body(b: tuple[str, ...], i: int, j: int) -> list[str]:
        if not b:
            return [""] if i == j else []
        if (b, i, j) not in memo:
            found = []
            for k in range(i + 1, j - len(b) + 2):
                for left in symbol(b[0], i, k):
                    found += [f"{left} {right}".rstrip() for right in body(b[1:], k, j)]
            memo[b, i, j] = found[:most]
        return memo[b, i, j]

    return symbol(start, 0, len(tokens))[:most]


def tagged(tree: str) -> str:
    """Each token with the symbol above it and its depth: ``a<A:2>``."""
    out, above = [], []
    for part in tree.replace("(", " ( ").replace(")", " ) ").split():
        if part == "(":
            above.append("")
        elif part == ")":
            above.pop()
        elif above[-1] == "":
            above[-1] = part
        else:
            out.append(f"{part}<{above[-1]}:{len(above)}>")
    return " ".join(out)


def trim(grammar: Grammar, start: str, size: int, seed: str) -> Grammar:
    """At most ``size`` rules where that is possible: first those the start needs, then others while they fit; start stays productive."""
    least = cheapest(grammar)
    if start not in least:
        return {}
    cost = lambda b: 1 + max((0 if s not in grammar else least[s] for s in b), default=0)
    kept: Grammar = {}
    todo = [start]
    while todo:  # one rule for each needed symbol, of those that end soonest
        head = todo.pop()
        if head not in kept:
            able = [b for b in grammar[head] if all(s not in grammar or s in least for s in b)]
            kept[head] = [min(able, key=lambda b: (cost(b), b))]
            todo += [s for s in kept[head][0] if s in grammar]
    rest = [(h, b) for h, bodies in grammar.items() for b in bodies if b not in kept.get(h, []) and all(s not in grammar or s in least for s in b)]
    order = choices(seed)
    for _, head, body in sorted((next(order), h, b) for h, b in rest):
        if sum(map(len, kept.values())) < size and head in kept and all(s not in grammar or s in kept for s in body):
            kept[head] = [*kept[head], body]
    return {h: sorted(b) for h, b in kept.items()}


def corrupt(grammar: Grammar, start: str, tokens: list[str], kind: int, place: int, token: str) -> list[str]:
    """A sentence with one token put in another's place, added, or taken out: kinds below 6, 8 and 10."""
    at = place % (len(tokens) + (6 <= kind < 8))
    if kind < 6:
        return [*tokens[:at], token, *tokens[at + 1 :]]
    return [*tokens[:at], token, *tokens[at:]] if kind < 8 else [*tokens[:at], *tokens[at + 1 :]]


def next_of_prefix(grammar: Grammar, start: str, prefix: list[str]) -> list[str]:
    """Tokens with which a prefix can go on to a sentence, STOP last where it is one; empty where it begins none."""
    pruned = cfg.prune(grammar, start)
    return cfg.next_tokens(pruned, start, prefix) if start in pruned else []
