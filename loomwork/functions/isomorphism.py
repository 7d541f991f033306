"""Exact isomorphism of small directed graphs: colours first, then a search within the colours."""

from __future__ import annotations

from collections import Counter, defaultdict

Edges = list[tuple[int, int]]


def _colours(nodes: list[int], out: dict, into: dict) -> dict[int, int]:
    """Refined until no class is split any more; equal numbers in two graphs mean equal neighbourhoods."""
    colour: dict[int, object] = {n: (len(out[n]), len(into[n])) for n in nodes}
    while True:
        finer = {n: (colour[n], tuple(sorted(map(repr, (colour[m] for m in out[n])))), tuple(sorted(map(repr, (colour[m] for m in into[n]))))) for n in nodes}
        names = {c: hash(repr(c)) for c in set(finer.values())}
        after = {n: names[finer[n]] for n in nodes}
        if len(set(after.values())) == len(set(colour.values())):
            return after
        colour = after


def isomorphic(a_nodes: list[int], a_edges: Edges, b_nodes: list[int], b_edges: Edges) -> bool:
    """Whether some renaming of the nodes turns one graph into the other."""
    if len(a_nodes) != len(b_nodes) or len(set(a_edges)) != len(set(b_edges)):
        return False
    sides = []
    for nodes, edges in ((a_nodes, a_edges), (b_nodes, b_edges)):
        out, into = defaultdict(set), defaultdict(set)
        for u, v in edges:
            out[u].add(v)
            into[v].add(u)
        sides.append((out, into, _colours(nodes, out, into)))
    (ao, ai, ac), (bo, bi, bc) = sides
    if Counter(ac.values()) != Counter(bc.values()):
        return False
    rare = Counter(ac.values())
    order = sorted(a_nodes, key=lambda n: (rare[ac[n]], n))
    image: dict[int, int] = {}
    used: set[int] = set()

    def fits(n: int, m: int) -> bool:
        return ac[n] == bc[m] and (n in ao[n]) == (m in bo[m]) and all((x in ao[n]) == (y in bo[m]) and (x in ai[n]) == (y in bi[m]) for x, y in image.items())

    tries = [iter([m for m in b_nodes if fits(order[0], m)])] if order else []
    while tries:
        n = order[len(tries) - 1]
        if n in image:
            used.discard(image.pop(n))
        m = next((m for m in tries[-1] if m not in used and fits(n, m)), None)
        if m is None:
            tries.pop()
            continue
        image[n] = m
        used.add(m)
        if len(image) == len(order):
            return True
        tries.append(iter(b_nodes))
    return not order
