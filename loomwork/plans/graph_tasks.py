"""A table of generated graphs, one for each row of ``customer``, and what is asked of each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.isomorphism import isomorphic
from loomwork.operators import graphs as g
from loomwork.plans.problems import _d, draw
from loomwork.scratch import materialise
from loomwork.scratch import table as t

#: Nodes of one graph get numbers of their own when graphs are worked through together.
SPAN = 100


def nodes(s, d) -> DataFrame:
    """(gid, n, u): five to eight nodes."""
    p = t(s, d, "customer").select(F.col("c_custkey").alias("gid")).withColumn("n", (5 + draw("gid", 100) % 4).cast("int"))
    return p.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))


def links(s, d) -> DataFrame:
    """(gid, a, b): undirected edges, a tree that keeps the graph in one piece and what its topology adds.

    Topologies: a tree only, chance edges, a ring, a grid of two columns.
    """
    v = nodes(s, d)
    tree = v.filter("u > 0").select("gid", (draw("gid", "u", 101) % F.col("u")).cast("int").alias("a"), F.col("u").alias("b"))
    pair = v.withColumn("b", F.explode(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda x: x > F.col("u"))))
    kind = draw("gid", 102) % 4
    grid = ((F.col("b") == F.col("u") + 1) & (F.col("u") % 2 == 0)) | (F.col("b") == F.col("u") + 2)
    ring = (F.col("b") == F.col("u") + 1) | ((F.col("u") == 0) & (F.col("b") == F.col("n") - 1))
    added = pair.filter(F.when(kind == 1, draw("gid", "u", "b", 103) % 100 < 25).when(kind == 2, ring).when(kind == 3, grid).otherwise(False))
    return tree.union(added.select("gid", F.col("u").alias("a"), "b")).distinct()


def edges(s, d) -> DataFrame:
    """(gid, u, v): the links directed; in four of five graphs a third of them only forward and a third only backward."""
    chance = F.when(draw("gid", 104) % 5 == 0, 99).otherwise(draw("gid", "a", "b", 105) % 99)
    both = links(s, d).withColumn("c", chance)
    return both.filter("c >= 33").select("gid", F.col("a").alias("u"), F.col("b").alias("v")).union(both.filter("c < 33 OR c >= 66").select("gid", F.col("b").alias("u"), F.col("a").alias("v")))


def g01_graphs(s, d):
    return edges(s, d)


# rendering ------------------------------------------------------------
def successors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, rows): each graph as an array of (u, after), both in order; a graph is small, a table of them need not be."""
    after = edges.groupBy("gid", "u").agg(F.array_sort(F.collect_set("v")).alias("after"))
    own = nodes.select("gid", "u").join(after, ["gid", "u"], "left").withColumn("after", F.coalesce("after", F.array().cast("array<int>")))
    return own.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("u", "after"))).alias("rows"))


def render(rows: Column, form: Column) -> Column:
    """A graph as text, in one of eight forms; the wording of each is fixed."""
    text = lambda x: x.cast("string")
    listed = lambda r, sep=", ": F.concat_ws(sep, F.transform(r["after"], text))
    each = lambda f, sep: F.concat_ws(sep, F.transform(rows, f))
    pairs = lambda f, sep: F.concat_ws(sep, F.flatten(F.transform(rows, lambda r: F.transform(r["after"], lambda v: f(r["u"], v)))))
    names = F.concat(F.lit("["), F.concat_ws(", ", F.transform(rows, lambda r: text(r["u"]))), F.lit("]"))
    arrow = lambda u, v: F.concat(text(u), F.lit("->"), text(v))
    none = lambda r: F.size(r["after"]) == 0
    forms = [
        each(lambda r: F.when(none(r), F.concat(F.lit("Node "), text(r["u"]), F.lit(" has no outgoing edges."))).otherwise(F.concat(F.lit("Node "), text(r["u"]), F.lit(" has directed edges to: "), listed(r), F.lit("."))), "\n"),
        F.concat(F.lit("Nodes "), names, F.lit(" and directed edges: "), pairs(lambda u, v: F.concat(F.lit("("), text(u), F.lit(", "), text(v), F.lit(")")), ", "), F.lit(".")),
        F.concat(F.lit("Adjacency Dictionary (source to targets): {"), each(lambda r: F.concat(text(r["u"]), F.lit(": ["), listed(r), F.lit("]")), ", "), F.lit("}")),
        F.concat(F.lit("Directed Edges: "), pairs(arrow, ", ")),
        F.concat(F.lit("Nodes: "), names, F.lit("\nAdjacency Matrix (row indicates source, column indicates target):\n"), each(lambda r: F.concat(F.lit("["), F.concat_ws(", ", F.transform(rows, lambda q: F.array_contains(r["after"], q["u"]).cast("int").cast("string"))), F.lit("]")), "\n")),
        F.concat(F.lit("digraph { "), pairs(arrow, "; "), F.lit(" }")),
        each(lambda r: F.when(none(r), F.concat(F.lit("Node "), text(r["u"]), F.lit(" has no outgoing links."))).otherwise(F.concat(F.lit("Node "), text(r["u"]), F.lit(" points to "), listed(r), F.lit("."))), " "),
        each(lambda r: F.when(none(r), F.concat(text(r["u"]), F.lit(":"))).otherwise(F.concat(text(r["u"]), F.lit(": "), F.concat_ws(" ", F.transform(r["after"], lambda v: arrow(r["u"], v))))), "; "),
    ]
    out = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        out = F.when(form == i, f).otherwise(out)
    return out


def g11_render(s, d):
    return successors(nodes(s, d), edges(s, d)).select("gid", render(F.col("rows"), F.col("gid") % 8).alias("text"))


# paths ----------------------------------------------------------------
def _spread(e: DataFrame) -> DataFrame:
    """Edges of all graphs as edges of one, nodes numbered apart."""
    return e.select((F.col("gid") * SPAN + F.col("u")).alias("u"), (F.col("gid") * SPAN + F.col("v")).alias("v"))


def g02_paths(s, d):
    """The shortest path from the first node to the last, of several the first in order; none where there is none."""
    ends = nodes(s, d).filter("u = 0").select("gid", "n")
    paths = g.shortest_paths(_spread(edges(s, d)), ends.select((F.col("gid") * SPAN).alias("node")))
    own = paths.select(F.floor(F.col("source") / SPAN).alias("gid"), (F.col("node") % SPAN).alias("u"), F.transform("path", lambda x: (x % SPAN).cast("string")).alias("path"))
    return ends.join(own.filter("u > 0"), "gid", "left").filter("u IS NULL OR u = n - 1").groupBy("gid").agg(F.max(F.concat_ws(">", "path")).alias("path")).join(ends.select("gid"), "gid", "right").select("gid", F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit("None")).alias("path"))


def g04_levels(s, d):
    """The nodes of each graph by their distance from the first."""
    start = nodes(s, d).filter("u = 0").select((F.col("gid") * SPAN).alias("node"))
    paths = g.shortest_paths(_spread(edges(s, d)), start)
    return paths.groupBy(F.floor(F.col("source") / SPAN).alias("gid"), (F.size("path") - 1).alias("level")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.col("node") % SPAN)), lambda x: x.cast("string"))).alias("queue"))


def dag(s, d) -> DataFrame:
    """Edges that go up in a random order of the nodes of each graph."""
    rank = lambda n: draw("gid", n, 106) * 100 + F.col(n)
    return edges(s, d).filter(rank("u") < rank("v"))


def g10_dag(s, d):
    return dag(s, d)


def g09_orders(s, d):
    """The ancestors of the last node of each graph's acyclic part in their first topological order, and the node itself."""
    e = materialise(dag(s, d), "dag")
    last = nodes(s, d).filter("u = n - 1").select("gid", F.col("u").alias("w"))
    up = g.closure(_spread(e)).select(F.floor(F.col("u") / SPAN).alias("gid"), (F.col("u") % SPAN).alias("u"), (F.col("v") % SPAN).alias("v"))
    kept = up.join(last, "gid").filter("v = w").select("gid", "u").union(last)
    inside = e.join(kept, ["gid", "u"], "left_semi").join(kept.withColumnRenamed("u", "v"), ["gid", "v"], "left_semi")
    return g.topological_orders(inside, "gid")


def g15_trees(s, d):
    """The two nodes of each graph's tree that are farthest apart, of several the first in order."""
    v = nodes(s, d)
    tree = v.filter("u > 0").select("gid", F.col("u"), (draw("gid", "u", 101) % F.col("u")).cast("int").alias("v"))
    both = tree.union(tree.select("gid", F.col("v").alias("u"), F.col("u").alias("v")))
    far = g.closure(_spread(both)).filter("u < v").select(F.floor(F.col("u") / SPAN).alias("gid"), (F.col("u") % SPAN).cast("int").alias("u"), (F.col("v") % SPAN).cast("int").alias("v"), "hops")
    return far.groupBy("gid").agg(F.min(F.struct(-F.col("hops"), "u", "v")).alias("m")).select("gid", "m.u", "m.v", (-F.col("m.col1")).alias("hops"))


def g12_disjoint(s, d):
    """Each graph beside the next one, whose nodes are numbered on."""
    v, e = nodes(s, d), edges(s, d)
    size = v.select("gid", "n").distinct()
    beside = e.select((F.col("gid") - 1).alias("gid"), "u", "v").join(size, "gid").select("gid", (F.col("u") + F.col("n")).alias("u"), (F.col("v") + F.col("n")).alias("v"))
    return e.join(size.select((F.col("gid") - 1).alias("gid")), "gid", "left_semi").unionByName(beside)


# isomorphism ----------------------------------------------------------
def small_edges(s, d) -> DataFrame:
    """(gid, u, v): graphs of five nodes, each possible edge with a chance of 0.3."""
    p = t(s, d, "customer").select(F.col("c_custkey").alias("gid")).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return p.filter((F.col("u") != F.col("v")) & (draw("gid", "u", "v", 110) % 100 < 30))


def changed_edges(s, d) -> DataFrame:
    """The same graphs renumbered; in two of three one pair of edges (a, b), (c, e) is first turned into (a, e), (c, b), all degrees kept."""
    e = small_edges(s, d)
    other = e.select("gid", F.col("u").alias("c"), F.col("v").alias("e"))
    swaps = e.join(other, "gid").filter("u < c AND v <> e AND u <> e AND c <> v")
    swaps = swaps.join(e.select("gid", "u", F.col("v").alias("e")), ["gid", "u", "e"], "left_anti").join(e.select("gid", F.col("u").alias("c"), "v"), ["gid", "c", "v"], "left_anti")
    chosen = swaps.filter(F.col("gid") % 3 > 0).groupBy("gid").agg(F.min(F.struct("u", "v", "c", "e")).alias("x"))
    gone = chosen.select("gid", F.explode(F.array(F.struct("x.u", "x.v"), F.struct(F.col("x.c").alias("u"), F.col("x.e").alias("v")))).alias("y")).select("gid", "y.u", "y.v")
    come = chosen.select("gid", F.explode(F.array(F.struct("x.u", F.col("x.e").alias("v")), F.struct(F.col("x.c").alias("u"), "x.v"))).alias("y")).select("gid", "y.u", "y.v")
    after = e.join(gone, ["gid", "u", "v"], "left_anti").unionByName(come)
    moved = lambda c: ((F.col(c) * 2 + F.col("gid")) % 5).cast("int").alias(c)
    return after.select("gid", moved("u"), moved("v"))


def isomorphic_pairs(pairs: DataFrame) -> DataFrame:
    """(gid, same) of pairs (gid, n, a, b) of edge arrays over nodes 0 to n - 1: exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = (batch.column(i).to_pylist() for i in range(1, 4))
            ends = lambda x: [(e["u"], e["v"]) for e in x or []]
            same = [isomorphic(list(range(k)), ends(x), list(range(k)), ends(y)) for k, x, y in zip(n, a, b, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(same, pa.bool_())], names=["gid", "same"])

    return pairs.select("gid", "n", "a", "b").mapInArrow(run, "gid long, same boolean")


def _pairs(s, d) -> DataFrame:
    listed = lambda e, name: e.groupBy("gid").agg(F.collect_list(F.struct("u", "v")).alias(name))
    both = listed(small_edges(s, d), "a").join(listed(changed_edges(s, d), "b"), "gid", "full")
    return t(s, d, "customer").select(F.col("c_custkey").alias("gid"), F.lit(5).alias("n")).join(both, "gid", "left")


def g06_exact(s, d):
    return isomorphic_pairs(_pairs(s, d))


def g06_degrees(s, d):
    """Nodes of each graph by their edges out and in, before and after: a swap must keep the counts."""
    def counts(e, name):
        per = e.groupBy("gid", F.col("u").alias("x")).agg(F.count("*").alias("o")).withColumn("i", F.lit(0)).unionByName(e.groupBy("gid", F.col("v").alias("x")).agg(F.count("*").alias("i")).withColumn("o", F.lit(0)))
        return per.groupBy("gid", "x").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).groupBy("gid", "o", "i").agg(F.count("*").alias(name))

    return counts(small_edges(s, d), "before").join(counts(changed_edges(s, d), "after"), ["gid", "o", "i"], "full").select("gid", "o", "i", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def z11_orders(s, d):
    """Orders of the nodes as answers, rising and without the last node in one graph of four: 1 where no edge is inverted and none is missing."""
    x = dag(s, d).groupBy("gid").agg(F.bool_and(F.col("u") < F.col("v")).alias("right"))
    whole = F.col("gid") % 4 != 0
    return nodes(s, d).select("gid").distinct().join(x, "gid", "left").select("gid", (whole & F.coalesce("right", F.lit(True))).cast("double").alias("score"))


def t04_neighbours(s, d):
    """Where suppliers of one nation stand to the next one by their balance."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    x = t(s, d, "supplier").select(F.col("s_suppkey").alias("a"), F.lead("s_suppkey").over(w).alias("b"), F.col("s_acctbal").alias("x"), F.lead("s_acctbal").over(w).alias("y")).filter("b IS NOT NULL")
    return x.select("a", "b", F.when(F.col("x") < F.col("y"), "left of").when(F.col("x") > F.col("y"), "right of").otherwise("with").alias("rel"))


def t10_cycles(s, d):
    """Whether "larger than" facts of each graph can all hold: whether no node is above itself."""
    loops = g.closure(_spread(edges(s, d))).filter("u = v").select(F.floor(F.col("u") / SPAN).alias("gid")).distinct().withColumn("bad", F.lit(True))
    return nodes(s, d).select("gid").distinct().join(loops, "gid", "left").select("gid", F.col("bad").isNull().alias("consistent"))


def z13_brands(s, d):
    """F1 of the brands of each pair of types that share one, by counting shared brands."""
    p = t(s, d, "part").select("p_type", "p_brand").distinct()
    n = p.groupBy("p_type").agg(F.count("*").alias("n"))
    hits = p.join(p.select(F.col("p_type").alias("other"), "p_brand"), "p_brand").filter("p_type < other").groupBy("p_type", "other").agg(F.count("*").alias("h"))
    both = hits.join(n, "p_type").join(n.select(F.col("p_type").alias("other"), F.col("n").alias("m")), "other")
    return both.select("p_type", "other", F.round(2.0 * F.col("h") / (F.col("n") + F.col("m")), 6).alias("score"))


# hierarchy ------------------------------------------------------------
def w03_cohyponyms(s, d):
    """How many others share the nearest class of each part, without forming the pairs."""
    p = t(s, d, "part")
    return p.select("p_partkey", (F.count("*").over(Window.partitionBy("p_type")) - 1).alias("others"))


def w07_odd_parts(s, d):
    """Of three neighbouring parts of one size the one whose brand the two others don't have but share."""
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    p = t(s, d, "part").select("p_partkey", F.col("p_brand").alias("a"), F.lead("p_brand", 1).over(w).alias("b"), F.lead("p_brand", 2).over(w).alias("c"))
    odd = F.expr("CASE WHEN a = b AND b <> c THEN 3 WHEN a = c AND b <> c THEN 2 WHEN b = c AND a <> b THEN 1 END")
    return p.select("p_partkey", odd.alias("odd")).filter("odd IS NOT NULL")


def w06_parts_all(s, d):
    """Orders by their number of different parts."""
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("n")).groupBy("n").agg(F.count("*").alias("orders"))


def queries() -> dict:
    return {n: f for n, f in globals().items() if n[:1] in "gwtz" and n[1:3].isdigit()}


_NODES = f"nd AS (SELECT gid, n, CAST(u AS INT) AS u FROM (SELECT CAST(c_custkey AS BIGINT) AS gid, CAST(5 + {_d('c_custkey', 100)} % 4 AS INT) AS n FROM customer), range(8) r(u) WHERE u < n)"
_EDGES = f"""{_NODES},
li AS (
  SELECT gid, CAST({_d('gid', 'u', 101)} % u AS INT) AS a, u AS b FROM nd WHERE u > 0
  UNION SELECT x.gid, x.u, y.u FROM nd x JOIN nd y ON x.gid = y.gid AND x.u < y.u WHERE CASE {_d('x.gid', 102)} % 4 WHEN 1 THEN {_d('x.gid', 'x.u', 'y.u', 103)} % 100 < 25
    WHEN 2 THEN y.u = x.u + 1 OR (x.u = 0 AND y.u = x.n - 1) WHEN 3 THEN (y.u = x.u + 1 AND x.u % 2 = 0) OR y.u = x.u + 2 ELSE false END),
lc AS (SELECT *, CASE WHEN {_d('gid', 104)} % 5 = 0 THEN 99 ELSE {_d('gid', 'a', 'b', 105)} % 99 END AS c FROM li),
ed AS (SELECT gid, a AS u, b AS v FROM lc WHERE c >= 33 UNION ALL SELECT gid, b, a FROM lc WHERE c < 33 OR c >= 66)"""
_SMALL = f"se AS (SELECT CAST(c_custkey AS BIGINT) AS gid, CAST(u AS INT) AS u, CAST(v AS INT) AS v FROM customer, range(5) r(u), range(5) q(v) WHERE u <> v AND {_d('c_custkey', 'u', 'v', 110)} % 100 < 30)"
_CHANGED = _SMALL + """,
sw AS (SELECT gid, min((u, v, c, e)) AS x FROM (SELECT a.gid, a.u, a.v, b.u AS c, b.v AS e FROM se a JOIN se b ON a.gid = b.gid AND a.u < b.u AND a.v <> b.v AND a.u <> b.v AND b.u <> a.v
  WHERE a.gid % 3 > 0 AND NOT EXISTS (SELECT 1 FROM se z WHERE z.gid = a.gid AND z.u = a.u AND z.v = b.v) AND NOT EXISTS (SELECT 1 FROM se z WHERE z.gid = a.gid AND z.u = b.u AND z.v = a.v)) GROUP BY gid),
af AS (
  SELECT se.gid, u, v FROM se LEFT JOIN sw USING (gid) WHERE x IS NULL OR NOT ((u = x[1] AND v = x[2]) OR (u = x[3] AND v = x[4]))
  UNION ALL SELECT gid, x[1], x[4] FROM sw UNION ALL SELECT gid, x[3], x[2] FROM sw),
ch AS (SELECT gid, CAST((u * 2 + gid) % 5 AS INT) AS u, CAST((v * 2 + gid) % 5 AS INT) AS v FROM af)"""


def oracle_sql() -> dict[str, str]:
    arrow = "u || '->' || v"
    rows = "ro AS (SELECT nd.gid, nd.u, list(v ORDER BY v) FILTER (WHERE v IS NOT NULL) AS a FROM nd LEFT JOIN ed USING (gid, u) GROUP BY 1, 2), "
    each = lambda text, sep: f"(SELECT string_agg({text}, '{sep}' ORDER BY u) FROM ro WHERE ro.gid = x.gid)"
    pairs = lambda text, sep: f"coalesce((SELECT string_agg({text}, '{sep}' ORDER BY u, v) FROM ed WHERE ed.gid = x.gid), '')"
    names = "'[' || " + each("CAST(u AS VARCHAR)", ", ") + " || ']'"
    nl = "' || chr(10) || '"
    listed = "array_to_string(a, ', ')"
    forms = [
        f"replace({each('CASE WHEN a IS NULL THEN ' + chr(39) + 'Node ' + chr(39) + ' || u || ' + chr(39) + ' has no outgoing edges.' + chr(39) + ' ELSE ' + chr(39) + 'Node ' + chr(39) + ' || u || ' + chr(39) + ' has directed edges to: ' + chr(39) + ' || ' + listed + ' || ' + chr(39) + '.' + chr(39) + ' END', '~')}, '~', chr(10))",
        f"'Nodes ' || {names} || ' and directed edges: ' || {pairs(chr(39) + '(' + chr(39) + ' || u || ' + chr(39) + ', ' + chr(39) + ' || v || ' + chr(39) + ')' + chr(39), ', ')} || '.'",
        f"'Adjacency Dictionary (source to targets): {{' || {each('u || ' + chr(39) + ': [' + chr(39) + ' || coalesce(' + listed + ', ' + chr(39) * 2 + ') || ' + chr(39) + ']' + chr(39), ', ')} || '}}'",
        f"'Directed Edges: ' || {pairs(arrow, ', ')}",
        f"'Nodes: ' || {names} || '{nl}Adjacency Matrix (row indicates source, column indicates target):{nl}' || replace((SELECT string_agg(m, '~' ORDER BY u) FROM (SELECT p.u, '[' || string_agg(CASE WHEN EXISTS (SELECT 1 FROM ed WHERE ed.gid = p.gid AND ed.u = p.u AND ed.v = q.u) THEN '1' ELSE '0' END, ', ' ORDER BY q.u) || ']' AS m FROM nd p JOIN nd q ON p.gid = q.gid WHERE p.gid = x.gid GROUP BY p.u)), '~', chr(10))",
        f"'digraph {{ ' || {pairs(arrow, '; ')} || ' }}'",
        each("CASE WHEN a IS NULL THEN 'Node ' || u || ' has no outgoing links.' ELSE 'Node ' || u || ' points to ' || " + listed + " || '.' END", " "),
        each("CASE WHEN a IS NULL THEN u || ':' ELSE u || ': ' || array_to_string(list_transform(a, lambda v: u || '->' || v), ' ') END", "; "),
    ]
    bfs = f"WITH RECURSIVE {_EDGES}, w AS (SELECT gid, u, [u] AS path, 0 AS depth FROM nd WHERE u = 0 UNION ALL SELECT gid, v, path, depth FROM (SELECT w.gid, e.v, list_append(w.path, e.v) AS path, w.depth + 1 AS depth, row_number() OVER (PARTITION BY w.gid, e.v ORDER BY list_append(w.path, e.v)) AS k FROM w JOIN ed e ON e.gid = w.gid AND e.u = w.u WHERE w.depth < 8 AND NOT list_contains(w.path, e.v)) WHERE k = 1), b AS (SELECT gid, u, arg_min(path, (depth, path)) AS path, min(depth) AS depth FROM w GROUP BY 1, 2) "
    dag = f"dg AS (SELECT gid, u, v FROM ed WHERE {_d('gid', 'u', 106)} * 100 + u < {_d('gid', 'v', 106)} * 100 + v)"
    perms = "pm AS (SELECT [a, b, c, e, f] AS p FROM range(5) r1(a), range(5) r2(b), range(5) r3(c), range(5) r4(e), range(5) r5(f) WHERE len(list_distinct([a, b, c, e, f])) = 5)"
    return {
        "g01_graphs": f"WITH {_EDGES} SELECT gid, u, v FROM ed",
        "g11_render": f"WITH {_EDGES}, {rows} x AS (SELECT DISTINCT gid FROM nd) SELECT gid, CASE gid % 8 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END AS text FROM x",
        "g02_paths": bfs + "SELECT nd.gid, coalesce(array_to_string(path, '>'), 'None') AS path FROM nd LEFT JOIN b USING (gid, u) WHERE nd.u = nd.n - 1",
        "g04_levels": bfs + "SELECT gid, depth AS level, string_agg(CAST(u AS VARCHAR), ',' ORDER BY u) AS queue FROM b GROUP BY 1, 2",
        "g10_dag": f"WITH {_EDGES}, {dag} SELECT gid, u, v FROM dg",
        "g09_orders": f"WITH RECURSIVE {_EDGES}, {dag}, an AS (SELECT gid, u FROM nd WHERE u = n - 1 UNION SELECT d.gid, d.u FROM an JOIN dg d ON d.gid = an.gid AND d.v = an.u), i AS (SELECT d.* FROM dg d JOIN an a ON a.gid = d.gid AND a.u = d.u JOIN an b ON b.gid = d.gid AND b.u = d.v), o AS (SELECT gid, CAST([] AS INT[]) AS ord, count(*) AS n FROM an GROUP BY gid HAVING count(*) > 1 UNION ALL SELECT o.gid, list_append(o.ord, min(an.u)), o.n FROM o JOIN an ON an.gid = o.gid AND NOT list_contains(o.ord, an.u) LEFT JOIN (SELECT gid, v, list(u) AS us FROM i GROUP BY 1, 2) q ON q.gid = an.gid AND q.v = an.u WHERE q.us IS NULL OR list_has_all(o.ord, q.us) GROUP BY o.gid, o.ord, o.n) SELECT gid, array_to_string(ord, ',') AS topo FROM o WHERE len(ord) = n",
        "g15_trees": f"WITH RECURSIVE {_NODES}, e AS (SELECT gid, u, CAST({_d('gid', 'u', 101)} % u AS INT) AS v FROM nd WHERE u > 0), b AS (SELECT * FROM e UNION ALL SELECT gid, v, u FROM e), w AS (SELECT gid, u AS a, u AS x, -1 AS f, 0 AS h FROM nd UNION ALL SELECT w.gid, w.a, b.v, w.x, h + 1 FROM w JOIN b ON b.gid = w.gid AND b.u = w.x AND b.v <> w.f) SELECT gid, u, v, hops FROM (SELECT gid, a AS u, x AS v, h AS hops, row_number() OVER (PARTITION BY gid ORDER BY h DESC, a, x) AS k FROM w WHERE a < x) WHERE k = 1",
        "g12_disjoint": f"WITH {_EDGES}, z AS (SELECT DISTINCT gid, n FROM nd) SELECT ed.gid, u, v FROM ed WHERE EXISTS (SELECT 1 FROM z WHERE z.gid = ed.gid + 1) UNION ALL SELECT ed.gid - 1, u + n, v + n FROM ed JOIN z ON z.gid = ed.gid - 1",
        "g06_exact": f"WITH {_CHANGED}, {perms}, x AS (SELECT gid, list(u * 5 + v ORDER BY u, v) AS l FROM se GROUP BY 1), y AS (SELECT gid, list(u * 5 + v ORDER BY u, v) AS l FROM ch GROUP BY 1), z AS (SELECT gid, bool_or(list_sort(list_transform(x.l, lambda i: p[i // 5 + 1] * 5 + p[i % 5 + 1])) = y.l) AS same FROM x JOIN y USING (gid), pm GROUP BY gid) SELECT c_custkey AS gid, coalesce(same, true) AS same FROM customer LEFT JOIN z ON gid = c_custkey",
        "g06_degrees": f"WITH {_CHANGED}, f AS (SELECT 'b' AS w, * FROM se UNION ALL SELECT 'a', * FROM ch), p AS (SELECT w, gid, x, sum(o) AS o, sum(i) AS i FROM (SELECT w, gid, u AS x, 1 AS o, 0 AS i FROM f UNION ALL SELECT w, gid, v, 0, 1 FROM f) GROUP BY 1, 2, 3) SELECT gid, CAST(o AS BIGINT) AS o, CAST(i AS BIGINT) AS i, count(*) FILTER (WHERE w = 'b') AS before, count(*) FILTER (WHERE w = 'a') AS after FROM p GROUP BY 1, 2, 3",
        "z11_orders": f"WITH {_EDGES}, {dag}, r AS (SELECT gid, bool_and(u < v) AS ok FROM dg GROUP BY 1) SELECT c_custkey AS gid, CASE WHEN c_custkey % 4 <> 0 AND coalesce(ok, true) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM customer LEFT JOIN r ON gid = c_custkey",
        "t04_neighbours": "SELECT a, b, CASE WHEN x < y THEN 'left of' WHEN x > y THEN 'right of' ELSE 'with' END AS rel FROM (SELECT s_suppkey AS a, lead(s_suppkey) OVER w AS b, s_acctbal AS x, lead(s_acctbal) OVER w AS y FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)) WHERE b IS NOT NULL",
        "t10_cycles": f"WITH RECURSIVE {_EDGES}, c AS (SELECT gid, u, v FROM ed UNION SELECT c.gid, c.u, ed.v FROM c JOIN ed ON ed.gid = c.gid AND ed.u = c.v) SELECT c_custkey AS gid, NOT EXISTS (SELECT 1 FROM c WHERE c.gid = c_custkey AND u = v) AS consistent FROM customer",
        "z13_brands": "WITH p AS (SELECT p_type, list(DISTINCT p_brand) AS r FROM part GROUP BY 1) SELECT a.p_type, b.p_type AS other, round(2.0 * len(list_intersect(a.r, b.r)) / (len(a.r) + len(b.r)), 6) AS score FROM p a JOIN p b ON a.p_type < b.p_type WHERE len(list_intersect(a.r, b.r)) > 0",
        "w03_cohyponyms": "SELECT p_partkey, count(*) OVER (PARTITION BY p_type) - 1 AS others FROM part",
        "w07_odd_parts": "SELECT p_partkey, odd FROM (SELECT p_partkey, CASE WHEN a = b AND b <> c THEN 3 WHEN a = c AND b <> c THEN 2 WHEN b = c AND a <> b THEN 1 END AS odd FROM (SELECT p_partkey, p_brand AS a, lead(p_brand, 1) OVER w AS b, lead(p_brand, 2) OVER w AS c FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey))) WHERE odd IS NOT NULL",
        "w06_parts_all": "SELECT n, count(*) AS orders FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1",
    }
