"""Set (S), graph (G) and is-a hierarchy (W) queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import graphs as g
from loomwork.scratch import materialise
from loomwork.scratch import table as t


def _text(c):
    return F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")


# sets -----------------------------------------------------------------
def _per_user(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events")
    return e.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("b"))


def s01_intersect(s, d):
    o = t(s, d, "orders")
    return o.filter("o_orderstatus = 'O'").select("o_custkey").intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))


def s01_intersect_rows(s, d):
    return _per_user(s, d).select("user_id", F.concat(F.lit("{"), F.array_join(F.array_sort(F.array_intersect("a", "b")), ", "), F.lit("}")).alias("shared"))


def s02_missing(s, d):
    """Numbers left out between the smallest and the largest line number of an order."""
    per = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.collect_set("l_linenumber").alias("have"))
    gaps = per.select("l_orderkey", F.array_except(F.sequence("lo", "hi"), "have").alias("m"))
    return gaps.filter(F.size("m") > 0).select("l_orderkey", _text("m").alias("missing"))


def s03_multiplicity(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n"))


def s04_set_equality(s, d):
    return _per_user(s, d).select("user_id", (F.array_sort("a") == F.array_sort("b")).alias("same"))


def s05_domains(s, d):
    n = s.range(60)
    return n.select("id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("iso"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "MMMM dd, yyyy").alias("long"), F.when(F.col("id") < 26, F.chr(F.col("id") + 97)).otherwise(F.concat(F.chr(F.floor(F.col("id") / 26) + 96), F.chr(F.col("id") % 26 + 97))).alias("letters"))


def s06_perturb(s, d):
    """The line numbers of an order without the smallest, with 99 added."""
    per = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("a"))
    return per.select("l_orderkey", _text(F.array_append(F.array_remove("a", F.element_at("a", 1)), F.lit(99))).alias("changed"))


def s07_cumulative(s, d):
    """Three changes one after the other, folded over an array of operations."""
    per = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("a"))
    ops = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in (("add", 50), ("remove", 1), ("add", 60))])
    step = lambda acc, o: F.when(o["k"] == "add", F.array_append(acc, o["x"])).otherwise(F.array_remove(acc, o["x"]))
    return per.select("l_orderkey", _text(F.aggregate(ops, F.col("a"), step)).alias("changed"))


def s08_jaccard(s, d):
    p = _per_user(s, d)
    return p.select("user_id", F.round(F.when(F.size(F.array_union("a", "b")) == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / F.greatest(F.size(F.array_union("a", "b")), F.lit(1))), 6).alias("j"))


def s09_sample(s, d):
    """A seeded sample: the ten customers of the smallest hash."""
    return t(s, d, "customer").select("c_custkey", F.md5(F.concat(F.lit("7:"), F.col("c_custkey").cast("string"))).alias("h")).orderBy("h").limit(10)


_PER_USER = """WITH p AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0), []) AS a, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 1), []) AS b FROM events GROUP BY user_id) """
_LINES = "WITH p AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS a FROM lineitem GROUP BY 1) "


# graphs ---------------------------------------------------------------
def _nation_edges(s: SparkSession, d: str) -> DataFrame:
    """Nations as a graph: k to 7k+3 and to k+1, modulo 25."""
    n = t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("u"))
    return n.select("u", F.explode(F.array((F.col("u") * 7 + 3) % 25, (F.col("u") + 1) % 25)).alias("v"))


def _dag(s: SparkSession, d: str) -> DataFrame:
    """Edges of the same graph that lead to a larger number."""
    return _nation_edges(s, d).filter("u < v")


def _isa(s: SparkSession, d: str) -> DataFrame:
    """Customer, nation, region: child to parent."""
    n, c = t(s, d, "nation"), t(s, d, "customer")
    up = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("u"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("v"))
    return up.unionByName(c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("u"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("v")))


def _all_paths(s, d):
    return g.shortest_paths(_nation_edges(s, d), t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node")))


def g02_shortest_path(s, d):
    pad = lambda p: F.array_join(F.transform(p, lambda x: F.lpad(x.cast("string"), 2, "0")), ">")
    return _all_paths(s, d).select("source", "node", pad(F.col("path")).alias("path"))


def g04_trace(s, d):
    return _all_paths(s, d).groupBy("source", (F.size("path") - 1).alias("level")).agg(_text(F.collect_list("node")).alias("queue"))


def g03_reach(s, d):
    return g.closure(_dag(s, d)).select("u", "v")


def g05_degree(s, d):
    e = t(s, d, "customer").select(F.col("c_nationkey").alias("u"), (F.col("c_custkey") % 25).cast("int").alias("v"))
    return g.most_central(e)


def g07_kth(s, d):
    return g.successor_after(t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("u"), ((F.col("n_nationkey").cast("long") * 7 + 3) % 25).alias("v")), 13)


def g09_topo(s, d):
    e = _dag(s, d).withColumn("grp", F.col("u") % 3)
    return g.topological_orders(e, "grp")


def g11_edge_list(s, d):
    return _nation_edges(s, d).groupBy().agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lpad(F.col("u").cast("string"), 2, "0"), F.lit("->"), F.lpad(F.col("v").cast("string"), 2, "0")))), "; ").alias("text"))


def g13_path_check(s, d):
    p = _all_paths(s, d).filter(F.size("path") > 1).select(F.concat_ws("-", "source", "node").alias("k"), "path")
    broken = p.select(F.concat("k", F.lit("x")).alias("k"), F.reverse("path").alias("path"))
    return g.check_paths(p.unionByName(broken), _nation_edges(s, d), "k").groupBy("valid").agg(F.count("*").alias("n"))


def g14_topo_check(s, d):
    """Whether the order by number inverts an edge, per node."""
    return _nation_edges(s, d).groupBy("u").agg(F.bool_and(F.col("u") < F.col("v")).alias("ok"))


def g15_farthest(s, d):
    return g.farthest(g.closure(_nation_edges(s, d)).filter("u <> v"))


def g16_frontier(s, d):
    """Where three steps backward from each node end or stop."""
    back = _dag(s, d).select(F.col("v").alias("u"), F.col("u").alias("v"))
    three = g.closure(back, 3)
    return three.groupBy("u").agg(F.count("*").alias("n"), F.max("hops").alias("deep"))


def g17_roots(s, d):
    e = _isa(s, d)
    return g.roots_above(e, g.closure(e)).groupBy("v").agg(F.count("*").alias("n")).filter("v LIKE 'r%'")


_REACH = "WITH RECURSIVE e AS (SELECT u, v FROM (SELECT CAST(n_nationkey AS BIGINT) AS u, (CAST(n_nationkey AS BIGINT) * 7 + 3) % 25 AS v FROM nation UNION ALL SELECT n_nationkey, (CAST(n_nationkey AS BIGINT) + 1) % 25 FROM nation)), "
_ISA = "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS u, 'r' || n_regionkey AS v FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), c AS (SELECT u, v FROM e UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u) "
_BFS = _REACH + """w AS (SELECT DISTINCT u AS source, u AS node, lpad(CAST(u AS VARCHAR), 2, '0') AS path, 0 AS depth FROM e UNION SELECT w.source, e.v, w.path || '>' || lpad(CAST(e.v AS VARCHAR), 2, '0'), depth + 1 FROM w JOIN e ON w.node = e.u WHERE depth < 8 AND position(lpad(CAST(e.v AS VARCHAR), 2, '0') IN w.path) = 0), b AS (SELECT source, node, min(depth) AS depth FROM w GROUP BY 1, 2), p AS (SELECT w.source, w.node, min(w.path) AS path, w.depth FROM w JOIN b USING (source, node, depth) GROUP BY 1, 2, 4) """


# hierarchy ------------------------------------------------------------
def w01_first_sense(s, d):
    """Of the parts of one name the one of highest price; ties by key."""
    p = t(s, d, "part")
    best = p.groupBy("p_brand").agg(F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("k"))).alias("b"))
    return best.select("p_brand", (-F.col("b.k")).alias("p_partkey"))


def w02_hypernym(s, d):
    return g.closure(_isa(s, d)).filter("hops = 2").select("u", "v")


def w03_siblings(s, d):
    n = t(s, d, "nation")
    return n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


def w04_is_a(s, d):
    return g.closure(_isa(s, d)).groupBy("v").agg(F.count("*").alias("below"))


def w05_lca(s, d):
    """Lowest shared ancestor of neighbouring customers."""
    up = materialise(g.closure(_isa(s, d)).filter("u LIKE 'c%'").withColumn("k", F.substring("u", 2, 20).cast("long")), "ancestors")
    pair = up.alias("a").join(up.alias("b"), F.expr("a.k + 1 = b.k AND a.v = b.v"))
    best = pair.groupBy(F.col("a.k").alias("a")).agg(F.min(F.struct(F.col("a.hops"), F.col("a.v"))).alias("m"))
    return best.select("a", F.col("m.v").alias("lca"))


def w08_distractors(s, d):
    """For each nation the three others of its region with the smallest hash."""
    h = F.md5(F.concat_ws(":", F.col("a"), F.col("b")))
    return g.rank_in(w03_siblings(s, d).withColumn("h", h), "a", "h").filter("rank <= 3").select("a", "b")


def queries() -> dict:
    own = {k: v for k, v in globals().items() if k[:1] in "sgw" and k[1:3].isdigit()}
    own["g08_ancestors"] = lambda s, d: g.closure(_dag(s, d).select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(_text(F.collect_set("v")).alias("ancestors"))
    own["g10_dagify"] = lambda s, d: _dag(s, d)
    own["g11_adjacency"] = lambda s, d: g.adjacency_text(_nation_edges(s, d))
    return own


def oracle_sql() -> dict[str, str]:
    return {
        "s01_intersect": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
        "s01_intersect_rows": _PER_USER + "SELECT user_id, '{' || array_to_string(list_sort(list_intersect(a, b)), ', ') || '}' AS shared FROM p",
        "s02_missing": "WITH r AS (SELECT l_orderkey, unnest(range(min(l_linenumber), max(l_linenumber) + 1)) AS x FROM lineitem GROUP BY 1) SELECT l_orderkey, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS missing FROM r WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.l_orderkey AND l.l_linenumber = x) GROUP BY 1",
        "s03_multiplicity": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n FROM events GROUP BY 1",
        "s04_set_equality": _PER_USER + "SELECT user_id, list_sort(a) = list_sort(b) AS same FROM p",
        "s05_domains": "SELECT CAST(i AS BIGINT) AS id, CAST(DATE '2020-01-01' + CAST(i AS INT) AS VARCHAR) AS iso, strftime(DATE '2020-01-01' + CAST(i AS INT), '%B %d, %Y') AS long, CASE WHEN i < 26 THEN chr(CAST(i + 97 AS INT)) ELSE chr(CAST(i // 26 + 96 AS INT)) || chr(CAST(i % 26 + 97 AS INT)) END AS letters FROM range(60) AS r(i)",
        "s06_perturb": _LINES + "SELECT l_orderkey, array_to_string(list_sort(list_append(a[2:], 99)), ',') AS changed FROM p",
        "s07_cumulative": _LINES + "SELECT l_orderkey, array_to_string(list_sort(list_append(list_filter(list_append(a, 50), lambda x: x <> 1), 60)), ',') AS changed FROM p",
        "s08_jaccard": _PER_USER + "SELECT user_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 6) AS j FROM p",
        "s09_sample": "SELECT c_custkey, md5('7:' || CAST(c_custkey AS VARCHAR)) AS h FROM customer ORDER BY h LIMIT 10",
        "g02_shortest_path": _BFS + "SELECT source, node, path FROM p",
        "g03_reach": _REACH + "c AS (SELECT u, v FROM e WHERE u < v UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u WHERE e.u < e.v) SELECT u, v FROM c",
        "g04_trace": _BFS + "SELECT source, depth AS level, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS queue FROM p GROUP BY 1, 2",
        "g05_degree": "WITH d AS (SELECT node, count(*) AS degree FROM (SELECT c_nationkey AS node FROM customer UNION ALL SELECT CAST(c_custkey % 25 AS INT) FROM customer) GROUP BY 1) SELECT node, degree FROM d WHERE degree = (SELECT max(degree) FROM d)",
        "g07_kth": "WITH RECURSIVE w AS (SELECT CAST(n_nationkey AS BIGINT) AS u, CAST(n_nationkey AS BIGINT) AS v, 0 AS k FROM nation UNION ALL SELECT u, (v * 7 + 3) % 25, k + 1 FROM w WHERE k < 13) SELECT u, v FROM w WHERE k = 13",
        "g08_ancestors": _REACH + "c AS (SELECT v AS u, u AS v FROM e WHERE u < v UNION SELECT c.u, e.u FROM c JOIN e ON c.v = e.v WHERE e.u < e.v) SELECT u, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS ancestors FROM c GROUP BY u",
        "g10_dagify": _REACH + "x AS (SELECT 1) SELECT u, v FROM e WHERE u < v",
        "g11_adjacency": _REACH + "x AS (SELECT DISTINCT u, v FROM e) SELECT u, CAST(u AS VARCHAR) || ': ' || string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) AS line FROM x GROUP BY u",
        "g11_edge_list": _REACH + "x AS (SELECT DISTINCT lpad(CAST(u AS VARCHAR), 2, '0') || '->' || lpad(CAST(v AS VARCHAR), 2, '0') AS t FROM e) SELECT string_agg(t, '; ' ORDER BY t) AS text FROM x",
        "g14_topo_check": _REACH + "x AS (SELECT 1) SELECT u, bool_and(u < v) AS ok FROM e GROUP BY u",
        "g15_farthest": _BFS + "SELECT source AS u, node AS v, depth AS hops FROM p WHERE source <> node ORDER BY depth DESC, source, node LIMIT 1",
        "g16_frontier": _REACH + "b AS (SELECT v AS u, u AS v FROM e WHERE u < v), c AS (SELECT u, v, 1 AS hops FROM b UNION SELECT c.u, b.v, hops + 1 FROM c JOIN b ON c.v = b.u WHERE hops < 3), m AS (SELECT u, v, min(hops) AS hops FROM c GROUP BY 1, 2) SELECT u, count(*) AS n, max(hops) AS deep FROM m GROUP BY u",
        "g17_roots": _ISA + "SELECT v, count(*) AS n FROM (SELECT DISTINCT u, v FROM c) WHERE u NOT IN (SELECT v FROM e) AND v LIKE 'r%' GROUP BY v",
        "w01_first_sense": "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1",
        "w02_hypernym": "SELECT 'c' || c_custkey AS u, 'r' || n_regionkey AS v FROM customer JOIN nation ON c_nationkey = n_nationkey",
        "w03_siblings": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
        "w04_is_a": _ISA + "SELECT v, count(*) AS below FROM (SELECT DISTINCT u, v FROM c) GROUP BY v",
        "w05_lca": "WITH x AS (SELECT c_custkey AS k, 'n' || c_nationkey AS n, 'r' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT a.k AS a, CASE WHEN a.n = b.n THEN a.n ELSE a.r END AS lca FROM x a JOIN x b ON a.k + 1 = b.k WHERE a.r = b.r",
        "w08_distractors": "SELECT a, b FROM (SELECT a.n_nationkey AS a, b.n_nationkey AS b, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY md5(a.n_nationkey || ':' || b.n_nationkey)) AS k FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey) WHERE k <= 3",
    }
