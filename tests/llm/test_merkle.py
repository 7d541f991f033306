"""Copies that differ in formatting."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import merkle

FORMS = merkle.Forms()


def digest(answer, metadata):
    found = FORMS.record(answer, metadata)
    return found and found[0]


SAME = [
    (("A b", '{"x": 1, "y": [1, 2]}'), ("a   B!", '{"Y":[1,2],\n"X":1}')),
    (("“q”", '{"k": "caf\\u00e9 x"}'), ("q", '{"k": "CAFÉ, x"}')),
    ((None, '{"a": {"b": 1, "c": {"d": 2, "e": 3}}}'), (None, ' {"a": {"c": {"e": 3, "d": 2}, "b": 1}} ')),
    (("2 + 3", "{}"), ("2+3.", "{ }")),
    (("5 ...", '{"t": "end ..."}'), ("5", '{"t": "end"}')),
]
DIFFERENT = [
    (("ab c", "{}"), ("a bc", "{}")), (("-1", "{}"), ("1", "{}")), (("1.5", "{}"), ("15", "{}")), (("a<b", "{}"), ("a>b", "{}")),
    (("x", '{"l": [1, 2]}'), ("x", '{"l": [2, 1]}')), (("x", '{"l": [[1], 2]}'), ("x", '{"l": [1, 2]}')), ((None, "{}"), ("", "{}")),
    (("x", '{"a": 1, "b": 2}'), ("x", '{"a": 2, "b": 1}')), (("x", '{"a": 1, "a": 1}'), ("x", '{"a": 1}')), (("1 2", "{}"), ("12", "{}")),
]


def test_pairs():
    for a, b in SAME:
        assert digest(*a) == digest(*b) is not None, (a, b)
    for a, b in DIFFERENT:
        assert digest(*a) != digest(*b), (a, b)


def test_no_records():
    for meta in (None, "", "null", "[1]", "{'a': 1}", '{"a": 1', "NaN", '{"a": NaN}', "b64:xx", '{"a":' * 100_000):
        assert digest("x", meta) is None


TREES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda t: st.lists(t, max_size=4) | st.dictionaries(st.text(), t, max_size=4), max_leaves=12)


def shuffled(value, rng):
    if isinstance(value, dict):
        items = list(value.items())
        rng.shuffle(items)
        return {k: shuffled(v, rng) for k, v in items}
    return [shuffled(v, rng) for v in value] if isinstance(value, list) else value


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(), TREES, max_size=4), st.randoms())
def test_layout_and_order_never_matter(tree, rng):
    a, b = json.dumps(tree), json.dumps(shuffled(tree, rng), indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
    if "\\ud" not in a:
        assert digest("q", a) == digest("q", b)


def table(spark, rows):
    return spark.createDataFrame([(i, a, m, b"x", 7) for i, a, m in rows], "row_id long, answer string, metadata string, digest binary, first_row_id int")


def brute(rows):
    first, out = {}, set()
    for i, a, m in sorted(rows):
        d = digest(a, m)
        if d is not None:
            if d in first and i != first[d]:
                out.add((first[d], i))
            first.setdefault(d, i)
    return out


def test_against_brute_force_with_a_hot_record(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        k = 0 if i % 3 == 0 else rng.randrange(900)  # a third of all rows is one record
        a = rng.choice([f"v {k}", f"V,  {k}!", f"“v” {k}"])
        fields = [f'"k": {k}', '"t": "x y"', '"n": null']
        rng.shuffle(fields)
        rows.append((i, a, "{" + ", ".join(fields) + "}" if i % 50 else None))
    rng.shuffle(rows)
    got = [tuple(r) for r in merkle.copies(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    per = {r.first_row_id: r.n_copies for r in merkle.distinct_records(table(spark, rows)).collect()}
    assert sum(per.values()) == len(rows)  # rows without metadata are records of their own


def test_empty_long_and_odd_rows(spark):
    assert merkle.copies(table(spark, [])).count() == 0
    assert [tuple(r) for r in merkle.distinct_records(table(spark, [(1, "x", None)])).collect()] == [(1, 1, None)]
    long = '{"t": "' + "word " * 300_000 + '"}'
    rows = [(2, "", long), (1, "!", long.upper()), (3, None, "{}"), (4, None, "{ }"), (4, None, "{}")]
    got = sorted(tuple(r) for r in merkle.copies(table(spark, rows)).collect())
    assert set(got) == {(1, 2), (3, 4)}


def test_equal_digests_of_different_structures_are_two_records(spark, monkeypatch):
    hashed = spark.createDataFrame([(1, b"d", "x"), (2, b"d", "y"), (3, b"d", "x")], merkle.SCHEMA)
    monkeypatch.setattr(merkle, "hashed_records", lambda df, unreadable: df)
    assert {(r.first_row_id, r.n_copies, r.digest) for r in merkle.distinct_records(hashed).collect()} == {(1, 2, "64"), (2, 1, "64")}


def test_deeply_nested_records(spark):
    deep = lambda n, x, gap="": '{"a":' + gap + '[{"b": ' * n + x + "}]" * n + "}"
    rows = [(1, "x", deep(3000, '"V"')), (2, "X", deep(3000, '"v"', "  ")), (3, "x", deep(3000, '"w"')), (4, "x", deep(2999, '"v"'))]
    assert {tuple(r) for r in merkle.copies(table(spark, rows)).collect()} == {(1, 2)}
