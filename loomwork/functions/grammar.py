"""Context-free grammars: parsing, next tokens, counts of parses."""

from __future__ import annotations

from collections import defaultdict

#: A small grammar of nested lists for the carrier queries: capital names are non-terminals.
BRACKETS = {"S": [("A",), ("S", "A")], "A": [("x",), ("(", "S", ")"), ("(", ")")]}
AMBIGUOUS = {"E": [("E", "+", "E"), ("n",)]}


def chart(grammar: dict, start: str, tokens: list[str]) -> list[set]:
    """Earley's chart: items (head, body, dot, origin) after each token."""
    columns: list[set] = [set() for _ in range(len(tokens) + 1)]
    columns[0] = {(start, b, 0, 0) for b in grammar[start]}
    for k, column in enumerate(columns):
        todo = list(column)
        while todo:
            head, body, dot, origin = todo.pop()
            new = []
            if dot == len(body):
                new = [(h, b, d + 1, o) for h, b, d, o in columns[origin] if d < len(b) and b[d] == head]
            elif body[dot] in grammar:
                new = [(body[dot], b, 0, k) for b in grammar[body[dot]]]
                # what is complete here already, of length zero
                new += [(head, body, dot + 1, origin)] if any(h == body[dot] and d == len(b) and o == k for h, b, d, o in column) else []
            elif k < len(tokens) and body[dot] == tokens[k]:
                columns[k + 1].add((head, body, dot + 1, origin))
            for item in new:
                if item not in column:
                    column.add(item)
                    todo.append(item)
    return columns


def accepts(grammar: dict, start: str, tokens: list[str]) -> bool:
    return any(h == start and d == len(b) and o == 0 for h, b, d, o in chart(grammar, start, tokens)[-1])


def next_tokens(grammar: dict, start: str, prefix: list[str]) -> list[str]:
    """Terminals that can follow a prefix; STOP last where it is a sentence."""
    last = chart(grammar, start, prefix)[-1]
    out = sorted({b[d] for _, b, d, _ in last if d < len(b) and b[d] not in grammar})
    return out + ["STOP"] * any(h == start and d == len(b) and o == 0 for h, b, d, o in last)


def first_error(grammar: dict, start: str, tokens: list[str]) -> int:
    """Place of the first token that no sentence has there; -1 for a sentence, the length where it only ends too early."""
    columns = chart(grammar, start, tokens)
    for k in range(1, len(columns)):
        if not columns[k]:
            return k - 1
    return -1 if accepts(grammar, start, tokens) else len(tokens)


def parses(grammar: dict, start: str, tokens: list[str], most: int = 2) -> int:
    """Number of parse trees, counted up to ``most``; grammars without empty or circular rules."""
    memo: dict = {}

    def seq(body: tuple, i: int, j: int) -> int:
        if not body:
            return int(i == j)
        key = (body, i, j)
        if key not in memo:
            memo[key] = 0
            need = len(body) - 1
            memo[key] = min(most, sum(sym(body[0], i, k) * seq(body[1:], k, j) for k in range(i + 1, j - need + 1)))
        return memo[key]

    def sym(s: str, i: int, j: int) -> int:
        if s not in grammar:
            return int(j == i + 1 and tokens[i] == s)
        key = (s, i, j)
        if key not in memo:
            memo[key] = 0
            memo[key] = min(most, sum(seq(b, i, j) for b in grammar[s]))
        return memo[key]

    return sym(start, 0, len(tokens))


def prune(grammar: dict, start: str) -> dict:
    """Rules whose symbols are reachable and productive."""
    productive: set[str] = set()
    while True:
        more = {h for h, bodies in grammar.items() if any(all(s not in grammar or s in productive for s in b) for b in bodies)}
        if more == productive:
            break
        productive = more
    kept = {h: [b for b in bodies if all(s not in grammar or s in productive for s in b)] for h, bodies in grammar.items() if h in productive}
    seen, todo = set(), [start]
    while todo:
        h = todo.pop()
        if h in kept and h not in seen:
            seen.add(h)
            todo += [s for b in kept[h] for s in b]
    return {h: b for h, b in kept.items() if h in seen}


def first_sets(grammar: dict) -> dict[str, set[str]]:
    """Terminals that can begin each symbol, with '' where it can be empty."""
    first: dict[str, set[str]] = defaultdict(set)
    changed = True
    while changed:
        changed = False
        for h, bodies in grammar.items():
            for b in bodies:
                add, empty = set(), True
                for s in b:
                    f = first[s] if s in grammar else {s}
                    add |= f - {""}
                    if "" not in f:
                        empty = False
                        break
                add |= {""} if empty else set()
                if not add <= first[h]:
                    first[h] |= add
                    changed = True
    return dict(first)
