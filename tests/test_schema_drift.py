"""Changes between files, and the unified table."""

import json

from loomwork.operators import schema_drift as sd

ROWS = "file_id long, stream string, file_no int, line_no int, record_json string"


def table(spark, files):
    rows = [(fid, stream, no, k, r if isinstance(r, str) or r is None else json.dumps(r)) for fid, stream, no, records in files for k, r in enumerate(records)]
    return spark.createDataFrame(rows, ROWS)


def changes(spark, files):
    return sorted((r.file_id, r.old_field, r.new_field) for r in sd.changes(table(spark, files)).collect())


def test_renames_types_and_ambiguity(spark):
    files = [
        (1, "s", 1, [{"level": 1, "meta": '{"_a": 1, "_b": "x"}'}, {"level": None, "note": None}]),
        (2, "s", 3, [{"lvl": 2, "meta": {"_a": 1.0, "_b": "x"}}]),
        (3, "s", 7, [{"p": 2, "q": 3, "meta": {"_a": 1.5, "_c": "x"}}]),
    ]
    assert changes(spark, files) == [
        (2, "level", "lvl"), (2, "meta", "meta"), (2, "metadata._a", "metadata._a"),
        (3, "", "p"), (3, "", "q"), (3, "lvl", ""), (3, "metadata._b", "metadata._c"),
    ]


def test_repeats_broken_rows_and_nulls(spark):
    files = [(1, "s", 1, [{"a": 1}, {"a": 1}, "no json", None, "[1]"]), (2, "s", 2, [None, "{"]), (None, "s", 3, [{"b": 1}]), (4, None, 4, [{"b": 1}])]
    assert changes(spark, files) == [(2, "a", "")]


def test_empty_table(spark):
    assert sd.changes(table(spark, [])).count() == 0
    assert sd.unify(table(spark, [])).count() == 0


def test_long_stream_crosses_stretches(spark):
    files = [(i, "s", i * 3000, [{"a" if i % 2 else "b": 1}]) for i in range(12)]
    assert len(changes(spark, files)) == 11


def test_unified_columns_and_clashing_names(spark):
    files = [(1, "s", 1, [{"level": 1, "line_no": 5, "Level": "x"}]), (2, "s", 2, [{"lvl": 2.5, "line_no": 6, "Level": "y"}])]
    got = sd.unify(table(spark, files))
    rows = {r["file_id"]: r.asDict() for r in got.collect()}
    assert rows[1]["line_no"] == 0 and rows[1]["record.line_no"] == 5
    assert len(got.columns) == len({c.lower() for c in got.columns})


def test_unified_table_follows_renames(spark):
    files = [(i, "s", i, [{"level" if i < 3 else "lvl": i}]) for i in range(1, 5)]
    rows = {r.file_id: r.level for r in sd.unify(table(spark, files)).collect()}
    assert rows == {1: 1, 2: 2, 3: 3, 4: 4}


def test_flooding_prefers_the_like(spark):
    scores = sd.flood([("tokens_in", "integer"), ("size", "integer")], [("tokens_inp", "integer"), ("weight", "integer")])
    assert scores["tokens_in", "tokens_inp"] > scores["tokens_in", "weight"]


def test_unified_types_hold_every_value(spark):
    records = [{"a": 1, "b": 2**53 + 1, "c": 5, "d": 1}, {"a": 2**64, "b": -(2**63), "c": 0.5, "d": 2}, {"a": -(2**63) - 1, "b": 0, "c": 2**53 + 1, "d": "x"}]
    files = [(1, "s", 1, records), (None, "s", 2, [{"only": 7}])]
    got = sd.unify(table(spark, files))
    rows = {(r.file_id, r.line_no): r for r in got.collect()}
    assert [rows[1, k].a for k in range(3)] == ["1", str(2**64), str(-(2**63) - 1)]
    assert [rows[1, k].b for k in range(3)] == [2**53 + 1, -(2**63), 0] and dict(got.dtypes)["b"] == "bigint"
    assert [rows[1, k].c for k in range(3)] == ["5", "0.5", str(2**53 + 1)]
    assert [rows[1, k].d for k in range(3)] == ["1", "2", "x"] and rows[None, 0].only == 7


def test_flooded_scores_decide(monkeypatch):
    old, new = [("a", "integer"), ("n", "string")], [("b", "integer"), ("n", "string")]
    assert ("a", "b", "renamed") in {c[:3] for c in sd.correspond(old, new)}
    monkeypatch.setattr(sd, "flood", lambda old, new: {})
    assert {c[:3] for c in sd.correspond(old, new)} == {("a", "", "removed"), ("", "b", "added")}
    assert sd.select({("a", "b"): 0.4, ("a", "c"): 0.01, ("d", "e"): 0.2}) == {("d", "e"): 0.2}


def test_deep_records_are_read():
    from loomwork.sources import jsonl

    line = '{"answer": ' + "[" * 4000 + '{"k": 1.5, "e": [], "o": {}}' + "]" * 4000 + ', "metadata": {"a": ["x", null, true]}}'
    value = jsonl.parse_object(line)
    assert jsonl.dump(value) == line and jsonl.parse_object("{" + '"a":{' * 4000) is None
