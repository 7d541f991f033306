"""Core operators against brute force, and every query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from loomwork.functions import automata, exact, grammar
from loomwork.operators import batches, graphs, joins, relational
from loomwork.plans import registry
from loomwork.plans.language import apply_diff

SF = os.environ.get("LOOMWORK_SF", "/root/testdata/sf0.001")
QUICK = ["q02_quantile_count_50", "q13_shard", "r04_markdown", "s02_missing", "g08_ancestors", "g07_kth", "k01_allen", "b10_elimination", "t01_fold", "l08_bracket_depth", "d02_mutate", "m04_cramer", "z02_scalar", "z14_js", "i26_budget", "f13_balanced_batch", "ext_as_of", "ext_stream_state"]


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    got = registry.queries()[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want.fetchall())


def test_all_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_positions_and_shards(spark):
    df = spark.createDataFrame([(x,) for x in [5, 5, 1, 9, None, 3, 7, 7]], "k int")
    pos = sorted((r.pos, r.k) for r in relational.global_position(df, "k", 4).collect())
    assert [p for p, _ in pos] == list(range(8)) and [k for _, k in pos[1:] if k] == sorted(k for _, k in pos[1:] if k)
    got = [r["count"] for r in relational.shards(spark.range(10), "id", 3).groupBy("shard").count().orderBy("shard").collect()]
    assert got == [4, 3, 3]


def test_closure_of_a_cycle(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 3), (None, 1)], "u int, v int")
    assert graphs.closure(e).count() == 10


def test_topological_order_of_a_cycle_is_null(spark):
    e = spark.createDataFrame([(1, 2, 0), (1, 0, 2), (2, 3, 1)], "g int, u int, v int")
    assert {r.g: r.topo for r in graphs.topological_orders(e, "g").collect()} == {1: None, 2: "3,1"}


def test_balanced_batch_equals_the_greedy_loop(spark):
    rows = [(i, i * 7 % 13 if i % 5 else None, None if i % 11 == 0 else f"b{i * 7 % 13 % 4}" if i % 5 else "b0") for i in range(200)]
    df = spark.createDataFrame(rows, "i int, d int, b string")
    seen, count, want = set(), {}, []
    for i, d, b in rows:
        if (d is not None and d in seen) or (b is not None and count.get(b, 0) >= 6):
            continue
        want.append(i)
        seen |= {d}
        count[b] = count.get(b, 0) + 1
    got = [r.i for r in batches.balanced_batch(df, ["i"], "d", "b", 6, 30).orderBy("i").collect()]
    assert got == want[:30]


def test_as_of_over_days(spark):
    left = spark.sql("SELECT * FROM VALUES (1, 'a', timestamp'2025-01-05 10:00:00'), (2, 'a', timestamp'2025-01-01 00:00:00'), (3, 'b', timestamp'2025-01-05 10:00:00') t(id, k, lt)")
    right = spark.sql("SELECT * FROM VALUES ('a', timestamp'2025-01-02 10:00:00', 7), ('a', timestamp'2025-01-01 00:00:00', 5), ('a', timestamp'2025-01-06 00:00:00', 9) t(k, rt, v)")
    assert {r.id: r.v for r in joins.as_of(left, right, "k", "lt", "rt", ["v"]).collect()} == {1: 7, 2: 5, 3: None}


def test_exact_arithmetic():
    assert exact.as_decimal(exact.evaluate("(7 - -3.5) * 0.2 // 1 % 3")) == "2"
    assert exact.evaluate("1 / 0") is None and exact.as_decimal(exact.evaluate("1/3")) is None
    assert exact.solve([[1, 1], [2, 2]], [1, 3]) == "inconsistent" and exact.solve([[1, 1], [2, 2]], [1, 2]) == "underdetermined"
    assert exact.unify("f(?x,g(?y))", "f(a,g(?x))") == {"?x": "a", "?y": "a"} and exact.unify("f(?x)", "f(g(?x))") is None
    assert exact.de_bruijn(exact.beta(exact.parse_lambda("(\\x.\\y.x) y"))) == "(L y)"


def test_grammar_and_automata():
    g = grammar.BRACKETS
    assert grammar.accepts(g, "S", list("(x())")) and grammar.first_error(g, "S", list("x)x")) == 1
    assert grammar.next_tokens(g, "S", list("x")) == ["(", "x", "STOP"]
    assert grammar.parses(grammar.AMBIGUOUS, "E", list("n+n+n")) == 2
    assert automata.witness("(a|b)*", "(a*b*)*") is None and automata.witness("a?b?", "(a|b)?") == "ab"
    assert apply_diff(["a", "b"], "@@ -1,2 +1,2 @@\n a\n-b\n+c") == ["a", "c"]


def test_every_state_of_an_order(spark, tmp_path):
    rows = [(1, 1, 5, 5, 3), (1, 2, 5, 5, 4), (2, 1, 6, 6, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in registry.queries()["c12_states"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 3, "after line 1: 3 held"), (1, 2, 7, "after line 2: 7 held"), (2, 1, 1, "after line 1: 1 held")}


def test_file_rewritten_with_the_same_size_has_two_keys(spark, tmp_path):
    times = spark.sql("SELECT 'a' AS file_path, 5L AS size_bytes, explode(array(timestamp'2025-01-01 10:00:00', timestamp'2025-01-01 10:00:00.5', NULL)) AS modified_at")
    times.unionByName(times).write.parquet(f"{tmp_path}/landing.parquet")
    got = {r.key for r in registry.queries()["i08_version"](spark, str(tmp_path)).collect()}
    assert len(got) == 3


def test_chains_longer_than_any_fixed_number_of_rounds(spark):
    e = spark.range(67).selectExpr("id AS u", "id + 1 AS v").coalesce(1)
    assert graphs.closure(e).count() == 67 * 68 // 2
    assert graphs.closure(e, 2).count() == 67 + 66
    paths = graphs.shortest_paths(e.filter("u < 35"), spark.sql("SELECT 0L AS node"))
    assert paths.count() == 36 and paths.selectExpr("max(size(path))").first()[0] == 36
