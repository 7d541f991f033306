"""Samples and mixes: shares, floors, caps, and odd input."""

import random
from collections import Counter

from loomwork.llm import mixing, sampling

TARGET = "level int, mode string, target_share double, min_rows int, sample_rows long"
ROWS = "row_id long, level int, mode string, _cat string, _key string"


def targets(spark, rows):
    return spark.createDataFrame(rows, TARGET)


def problems(spark, counts, seed=0):
    rows, i = [], 0
    for (level, mode), n in counts.items():
        for _ in range(n):
            i += 1
            rows.append((i, level, mode, "x", "y"))
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, ROWS)


def taken(df):
    return Counter((r.level, sampling_mode(r.mode)) for r in df.collect())


def sampling_mode(mode):
    return "".join(c for c in mode.lower() if c.isalnum())


def test_shares_hot_category_and_spellings(spark):
    df = problems(spark, {(0, "instruct"): 1500, (0, " In-Struct\t"): 200, (1, "few_shot"): 700, (None, "instruct"): 50, (1, None): 50, (2, "other"): 60})
    t = targets(spark, [(0, "instruct", 0.6, 2, 500), (1, "Few Shot", 0.4, 2, 500)])
    got = taken(sampling.sample_to_targets(df, t, key_cols=["row_id"]))
    assert got == {(0, "instruct"): 300, (1, "fewshot"): 200}


def test_fractional_shares_add_up(spark):
    df = problems(spark, {(k, "m"): 300 for k in range(7)})
    t = targets(spark, [(k, "m", 1 / 7, 1, 100) for k in range(7)])
    got = taken(sampling.sample_to_targets(df, t, key_cols=["row_id"]))
    assert sum(got.values()) == 100 and set(got.values()) <= {14, 15}


def test_floors_are_repaired(spark):
    df = problems(spark, {(0, "a"): 500, (1, "b"): 40, (2, "c"): 3})
    t = targets(spark, [(0, "a", 0.97, 2, 100), (1, "b", 0.02, 20, 100), (2, "c", 0.01, 9, 100)])
    got = taken(sampling.sample_to_targets(df, t, key_cols=["row_id"]))
    assert got == {(0, "a"): 77, (1, "b"): 20, (2, "c"): 3}
    report = {r.level: r for r in sampling.sample_report(df, t).collect()}
    assert {k: (r.taken, r.short) for k, r in report.items()} == {0: (77, False), 1: (20, False), 2: (3, True)}
    assert [(r.level, r.mode) for r in sampling.short_categories(df, t).collect()] == [(2, "c")]


def test_sample_larger_than_the_table(spark):
    df = problems(spark, {(0, "a"): 5, (1, "b"): 7})
    t = targets(spark, [(0, "a", 0.5, 2, 100), (1, "b", 0.5, 2, 100)])
    assert taken(sampling.sample_to_targets(df, t, key_cols=["row_id"])) == {(0, "a"): 5, (1, "b"): 7}


def test_every_row_can_be_drawn_and_repeats_count(spark):
    df = problems(spark, {(0, "a"): 40})
    df = df.unionByName(df)  # ties of the random key
    t = targets(spark, [(0, "a", 1.0, 1, 40)])
    assert sampling.sample_to_targets(df, t, key_cols=["row_id"]).count() == 40
    seen = {r.row_id for s in range(8) for r in sampling.sample_to_targets(df, t, seed=s, key_cols=["row_id"]).collect()}
    assert len(seen) == 40


def test_empty_tables(spark):
    t = targets(spark, [(0, "a", 1.0, 1, 40)])
    assert sampling.sample_to_targets(problems(spark, {}), t).count() == 0
    assert sampling.short_categories(problems(spark, {}), t).count() == 1
    assert sampling.sample_report(problems(spark, {(0, "a"): 1}), targets(spark, [])).count() == 0


CORPUS = "row_id long, source string, prompt string, completion string, tokens long, _slice int"
MIX = "source string, weight double, max_passes int, total_tokens long"


def corpus(spark, rows):
    return spark.createDataFrame([(i, s, p, c, 99, 1) for i, s, p, c in rows], CORPUS)


def test_budgets_passes_and_repeats(spark):
    rows = [(i, "big", "a b c", "d") for i in range(1000)] + [(2000 + i, "small", "x y", None) for i in range(50)]
    rows += rows[:200]  # exact repeats
    rows += [(None, "small", "z", "z"), (None, "small", "z", "z"), (5000, None, "a", "b"), (5001, "other", "a", "b"), (5002, "big", None, None)]
    mix = spark.createDataFrame([("big", 0.8, 1, 1000), ("small", 0.2, 3, 1000), ("absent", 0.0, 3, 1000)], MIX)
    used = mixing.mix_sources(corpus(spark, rows), mix).collect()
    total = Counter()
    for r in used:
        total[r.source] += r.tokens
    assert 798 <= total["big"] <= 802 and 198 <= total["small"] <= 202
    uses = Counter(r.row_id for r in used if r.source == "small" and r.row_id)
    assert max(uses.values()) <= 3 and min(uses.values()) >= 1 and len(uses) == 50
    assert max(Counter(r.row_id for r in used if r.source == "big").values()) == 1
    assert [r.source for r in mixing.short_sources(corpus(spark, rows), mix).collect()] == []


def test_caps_make_a_source_short(spark):
    mix = spark.createDataFrame([("s", 0.5, 2, 100), ("absent", 0.5, 9, 100)], MIX)
    rows = corpus(spark, [(i, "s", "a b c d", "") for i in range(3)])
    assert sorted(r.source for r in mixing.short_sources(rows, mix).collect()) == ["absent", "s"]
    report = {r.source: r for r in mixing.mix_report(rows, mix).collect()}
    assert report["s"].used == 24 and report["s"].passes == 2 and report["s"].actual_share == 1.0 and report["absent"].used == 0


def test_cut_is_in_random_order_and_stable(spark):
    mix = spark.createDataFrame([("s", 1.0, 1, 50)], MIX)
    rows = corpus(spark, [(i, "s", "a", None) for i in range(200)])
    first, again = ({r.row_id for r in mixing.mix_sources(rows, mix).collect()} for _ in range(2))
    assert first == again and len(first) == 50 and max(first) > 100


def test_empty_corpus(spark):
    mix = spark.createDataFrame([("s", 1.0, 1, 50)], MIX)
    assert mixing.mix_sources(corpus(spark, []), mix).count() == 0
    assert [(r.used, r.short) for r in mixing.mix_report(corpus(spark, []), mix).collect()] == [(0, True)]
