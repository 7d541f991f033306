"""Exact token counts, and containers."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import bpe, packing, tokens

ENC = bpe.load(bpe.RANKS)[0]
WILD = ["", None, " ", "\n\n  \t x", "a" * 5000, "Ünïcödé 漢字 😀😀 x", "it's we'll 'S", "1234567890" * 50, "  a　", "<|endoftext|>", "é‍", "x" + " " * 3000 + "y"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=24), min_size=1, max_size=8))
def test_states_are_exact_for_any_bytes(pieces):
    states = bpe.PrefixStates()
    for p in sorted(pieces):
        assert states.tokens(p) == len(ENC._encode_single_piece(p))


def count(text):
    return len(ENC.encode_ordinary(text)) if text else 0


def corpus(spark, rows):
    schema = "row_id long, source string, lang string, task string, level int, prompt string, completion string, tokens string, key int"
    return spark.createDataFrame([(i, s, None, "t", None, p, c, "old", 1) for i, s, p, c in rows], schema)


def test_rows_and_totals(spark):
    rows = [(i, "s" if i % 2 else None, a, b) for i, (a, b) in enumerate((a, b) for a in WILD for b in WILD[:6])]
    rows += rows[:7]
    got = tokens.tokens_by_row(corpus(spark, rows)).collect()
    want = sorted((i, count(a), count(b)) for i, _, a, b in rows)
    assert sorted((r.row_id, r.prompt_tokens, r.completion_tokens) for r in got) == want
    totals = {r.source: r for r in tokens.token_totals(corpus(spark, rows)).collect()}
    assert sum(r.tokens for r in totals.values()) == sum(a + b for _, a, b in want)
    assert sum(r.distinct_rows for r in totals.values()) == len(rows) - 7 and sum(r.n_rows for r in totals.values()) == len(rows)


def test_no_rows(spark):
    assert tokens.tokens_by_row(corpus(spark, [])).count() == 0 and tokens.token_totals(corpus(spark, [])).count() == 0


def docs(spark, rows):
    return spark.createDataFrame([(i, t, a, "x", 1) for i, t, a in rows], "doc_id long, text string, task string, shard string, tokens int")


def kinds(spark, rows):
    return spark.createDataFrame(rows, "container_kind string, capacity_tokens int")


def test_everything_is_packed_once(spark):
    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 10, 40, 200, 900]))), "hot" if i % 3 else None) for i in range(400)]
    rows += [(900, "", "hot"), (901, None, None), (902, rows[0][1], "hot"), (902, rows[1][1], "hot")]
    placed = packing.pack_documents(docs(spark, rows), kinds(spark, [("a", 128), ("b", 1024), ("b", 1024)]))
    out = placed.collect()
    size: dict = {}
    for i, text, _ in rows:
        size.setdefault(i, []).append(count(text))
    for kind, capacity in (("a", 128), ("b", 1024)):
        own = [r for r in out if r.container_kind == kind]
        fill: dict = {}
        for r in own:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values()) <= capacity
        assert all(r.fill == fill[r.container_id] for r in own)
        items = [x for v in size.values() for n in v for x in [capacity] * (n // capacity) + [n % capacity]]
        assert len(fill) <= 1.05 * (max(packing.first_fit(items, capacity)) + 1)  # as full as without regard to terms
        for i, wanted in size.items():
            pieces = sorted((r.first_token, r.n_tokens) for r in own if r.doc_id == i)
            assert sum(n for _, n in pieces) == sum(wanted)
            if len(wanted) == 1 and wanted[0] <= capacity:
                assert len(pieces) == 1
            if len(wanted) == 1 and wanted[0] > capacity:
                assert [f for f, _ in pieces] == [k * capacity for k in range(len(pieces))]
    report = {r.container_kind: r for r in packing.packing_report(placed).collect()}
    assert set(report) == {"a", "b"} and report["a"].fullest <= 128


def test_neighbours_share_terms():
    terms = [[1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5], [11, 12], [13, 14], [15, 16], [17, 18]]
    out = packing.pack_shard(list(range(8)), [50] * 4 + [60] * 4, terms, [[1] * len(t) for t in terms], 100)
    groups = {frozenset(k for k, *_ in c) for c in out}
    assert {frozenset({0, 2}), frozenset({1, 3})} <= groups


def test_bm25_equals_the_direct_formula():
    import math

    rng = random.Random(1)
    terms = [rng.sample(range(30), 6) for _ in range(40)]
    counts = [[rng.randrange(1, 4) for _ in t] for t in terms]
    import numpy as np

    index = packing.Index([np.array(t) for t in terms], [np.array(c) for c in counts])
    lengths = [sum(c) for c in counts]
    mean = sum(lengths) / 40
    df = {t: sum(t in x for x in terms) for t in range(30)}
    want = [sum(max(0, math.log((40 - df[t] + 0.5) / (df[t] + 0.5))) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean)) for t, c in zip(ts, cs, strict=True) if t in terms[3] and df[t] > 1) for ts, cs, n in zip(terms, counts, lengths, strict=True)]
    assert np.allclose(index.scores(3), want)


def test_empty_packing(spark):
    assert packing.pack_documents(docs(spark, []), kinds(spark, [("a", 10)])).count() == 0
    assert packing.pack_documents(docs(spark, [(1, "x y", None)]), kinds(spark, [])).count() == 0
