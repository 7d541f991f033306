"""Leaked passages against brute force."""

import random

from loomwork.llm import leakage


def brute(docs, items, words):
    out = set()
    for d, text in docs:
        w = leakage.words_of(text)
        grams = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
        for i, prompt in items:
            v = leakage.words_of(prompt)
            if any(tuple(v[k : k + words]) in grams for k in range(len(v) - words + 1)):
                out.add((d, i))
    return out


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, longest int")
    return d, spark.createDataFrame([(i, p, "x") for i, p in items], "item_id long, prompt string, doc_id string")


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("alpha beta gamma delta Ünder 12 x7 zeta".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 12, 13, 40])))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for i in range(150):
        w = [word() for _ in range(rng.choice([0, 5, 60, 300]))]
        if w and i % 2:
            p = leakage.words_of(rng.choice(items[:25])[1])
            k = rng.randrange(len(p))
            w[rng.randrange(len(w)) :] = [x.upper() + rng.choice(["", ",", "!\n"]) for x in p[k : k + rng.choice([11, 13, 20])]] + [word()]
        docs.append((i, rng.choice([" ", "\n", " -- ", "_"]).join(w)))
    docs += [(500, None), (501, ""), (3, docs[1][1])]
    d, t = tables(spark, docs, items)
    got = [tuple(r) for r in leakage.leaked_items(d, t, 13).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, 13)


def test_blocks_change_nothing(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(9)]
    docs = [(i, " ".join(p for _, p in items[i : i + 2])) for i in range(9)]
    d, t = tables(spark, docs, items)
    monkeypatch.setattr(leakage, "BLOCK_SEEDS", 20)
    assert {tuple(r) for r in leakage.leaked_items(d, t).collect()} == brute(docs, items, 13)


def test_reordered_passages_are_covered(spark):
    a, b, c = ([f"{x}{k}" for k in range(9)] for x in "abc")
    d, t = tables(spark, [(1, " ".join(c + ["q"] + a + ["r"] + b)), (2, " ".join(a))], [(7, " ".join(a + b + c))])
    got = [(r.doc_id, r.item_id, r.tiles, r.coverage) for r in leakage.covered_items(d, t).collect()]
    assert got == [(1, 7, 3, 1.0)]
    assert leakage.leaked_items(d, t).count() == 0


def test_tiles_never_overlap():
    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        doc, item = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, 60))]) for _ in range(2))
        tiles = leakage.tile(doc, item, 3)
        assert sum(tiles) <= min(len(doc), len(item)) and sorted(tiles, reverse=True) == tiles
        longest = max([n for n in range(3, 61) if {tuple(doc[i : i + n]) for i in range(len(doc) - n + 1)} & {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}], default=0)
        assert (tiles or [0])[0] == longest


def test_long_text_and_empty_tables(spark):
    passage = " ".join(f"p{k}" for k in range(13))
    d, t = tables(spark, [(1, "noise " * 400_000 + passage)], [(1, passage)])
    assert leakage.leaked_items(d, t).count() == 1
    d, t = tables(spark, [], [(1, passage)])
    assert leakage.leaked_items(d, t).count() == 0
    d, t = tables(spark, [(1, passage)], [])
    assert leakage.leaked_items(d, t).count() == 0


def test_periodic_texts_stay_quick():
    import time

    import numpy as np

    began = time.perf_counter()
    assert leakage.tile(np.array([1, 2] * 5000), np.array([2, 1] * 200), 5) == [400]
    assert time.perf_counter() - began < 5


def test_tiles_decide(spark, monkeypatch):
    a, b = ([f"{x}{k}" for k in range(13)] for x in "ab")
    d, t = tables(spark, [(1, " ".join([*a, "z", *b[:6]]))], [(7, " ".join(a + b))])
    assert [(r.longest, r.tiles, r.covered) for r in leakage.leaked_passages(d, t).collect()] == [(13, 2, 19)]
    monkeypatch.setattr(leakage, "tile", lambda doc, item, least: [])
    assert leakage.leaked_items(d, t).count() == 0
