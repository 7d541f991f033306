"""Calculi (K), inference (B), tracking (T) and constraints (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators import calculi as k
from loomwork.scratch import table as t


# calculi --------------------------------------------------------------
def _spans(s: SparkSession, d: str) -> DataFrame:
    """From the first to the last ship day of an order, in days."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return t(s, d, "lineitem").groupBy("l_orderkey").agg(F.min(day).alias("a0"), (F.max(day) + 1).alias("a1"))


def _neighbours(s, d):
    x = _spans(s, d)
    nxt = x.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("a0").alias("b0"), F.col("a1").alias("b1"))
    return x.join(nxt, "l_orderkey")


def _cols():
    return [F.col(c) for c in ("a0", "a1", "b0", "b1")]


def k01_allen(s, d):
    return _neighbours(s, d).select("l_orderkey", k.allen(*_cols()).alias("rel"))


def k02_rcc8(s, d):
    return _neighbours(s, d).select("l_orderkey", k.rcc8(*_cols()).alias("rel"))


def k03_cardinal(s, d):
    return _neighbours(s, d).select("l_orderkey", F.concat(k.coarse(*_cols(), "W", "M", "E"), k.coarse(F.col("a1") - F.col("a0"), F.col("a1"), F.col("b1") - F.col("b0"), F.col("b1"), "S", "M", "N")).alias("rel"))


def k06_product(s, d):
    """Pairs of relations of the calculus with itself."""
    names = s.createDataFrame([(n,) for n in k.ALLEN], "a string")
    return names.crossJoin(names.withColumnRenamed("a", "b"))


def k07_path_consistency(s, d):
    """Chains of neighbouring orders, four links each: what any two of a chain can be."""
    rel = k01_allen(s, d)
    facts = rel.select((F.col("l_orderkey") / 4).cast("long").alias("grp"), (F.col("l_orderkey") % 4).cast("int").alias("i"), (F.col("l_orderkey") % 4 + 1).cast("int").alias("j"), "rel")
    table = [tuple(r) for r in k.composition(s, 3).collect()]
    return k.path_consistency(facts, table)


# inference ------------------------------------------------------------
def _joint(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


def _cpt(s, d):
    j = _joint(s, d).groupBy("l_returnflag", "l_linestatus").agg(F.sum("n").alias("n"))
    return j.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag"))).drop("n")


def _prior(s, d):
    c = t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return c.select("l_returnflag", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit("all")))).alias("q"))


def b01_noisy_or(s, d):
    """1 minus the product of the failures of a user's event types, with a leak of 0.05."""
    rate = t(s, d, "events").groupBy("user_id", "event_type").agg((F.count("*") / 100.0).alias("p"))
    return rate.groupBy("user_id").agg(F.round(1 - 0.95 * F.product(1 - F.least(F.col("p"), F.lit(1.0))), 6).alias("p"))


def b01_noisy_and(s, d):
    rate = t(s, d, "events").groupBy("user_id", "event_type").agg((F.count("*") / 100.0).alias("p"))
    return rate.groupBy("user_id").agg(F.round(F.product(F.least(F.col("p"), F.lit(1.0))), 8).alias("p"))


def b02_noisy_max(s, d):
    """Distribution of the largest of a user's independent values: product of their distribution functions, then differences."""
    e = t(s, d, "events").withColumn("level", F.pmod(F.floor("value"), F.lit(3)).cast("int")).filter("value IS NOT NULL")
    n = e.groupBy("event_type", "level").agg(F.count("*").alias("n"))
    grid = n.select("event_type").distinct().join(F.broadcast(s.range(3).select(F.col("id").cast("int").alias("level"))))
    full = grid.join(n, ["event_type", "level"], "left").fillna(0, ["n"])
    w = Window.partitionBy("event_type")
    cdf = full.withColumn("c", F.sum("n").over(w.orderBy("level")) / F.sum("n").over(w))
    m = cdf.groupBy("level").agg(F.product("c").alias("c"))
    return m.select("level", F.round(F.col("c") - F.coalesce(F.lag("c").over(Window.orderBy("level")), F.lit(0.0)), 6).alias("p"))


def b04_largest_remainder(s, d):
    """Shares of event types in whole percent that add up to 100."""
    c = t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit("all"))
    share = c.withColumn("x", F.col("n") * 100.0 / F.sum("n").over(every)).withColumn("f", F.floor("x"))
    left = share.withColumn("rest", 100 - F.sum("f").over(every)).withColumn("k", F.row_number().over(every.orderBy(F.desc(F.round(F.col("x") - F.col("f"), 9)), "event_type")))
    return left.select("event_type", (F.col("f") + F.when(F.col("k") <= F.col("rest"), 1).otherwise(0)).cast("long").alias("pct"))


def b05_product(s, d):
    return _cpt(s, d).join(_prior(s, d), "l_returnflag").select("l_returnflag", "l_linestatus", F.round(F.col("p") * F.col("q"), 6).alias("p"))


def b06_marginal(s, d):
    return _cpt(s, d).join(_prior(s, d), "l_returnflag").groupBy("l_linestatus").agg(F.round(F.sum(F.col("p") * F.col("q")), 6).alias("p"))


def b07_evidence(s, d):
    return _joint(s, d).filter("l_linestatus = 'O'").groupBy("l_returnflag").agg(F.sum("n").alias("n"))


def b08_posterior(s, d):
    e = b07_evidence(s, d)
    return e.select("l_returnflag", F.round(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit("all")))), 6).alias("p"))


def b10_elimination(s, d):
    """P(line number | status = F): the flag is summed out of a product of three factors."""
    pl = _joint(s, d).groupBy("l_returnflag", "l_linenumber").agg(F.sum("n").alias("n"))
    pl = pl.withColumn("r", F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag"))).drop("n")
    f = _cpt(s, d).filter("l_linestatus = 'F'").join(_prior(s, d), "l_returnflag").join(pl, "l_returnflag")
    m = f.groupBy("l_linenumber").agg(F.sum(F.col("p") * F.col("q") * F.col("r")).alias("x"))
    return m.select("l_linenumber", F.round(F.col("x") / F.sum("x").over(Window.partitionBy(F.lit("all"))), 6).alias("p"))


def b11_do(s, d):
    """The status after the flag is set to R: its own prior is replaced by a certainty."""
    point = s.createDataFrame([("R", 1.0)], "l_returnflag string, q double")
    return _cpt(s, d).join(F.broadcast(point), "l_returnflag").groupBy("l_linestatus").agg(F.round(F.sum(F.col("p") * F.col("q")), 6).alias("p"))


def b16_answer(s, d):
    return b08_posterior(s, d).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_returnflag", F.round("p", 2).cast("string")))))).alias("answer"))


# tracking -------------------------------------------------------------
def t01_moves(s, d):
    """Position of each user after each event, along the events in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select("event_id", "user_id", F.sum(F.floor(F.coalesce("value", F.lit(0.0))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"))


def t01_fold(s, d):
    """The same end by a fold over an ordered array; jumps to 0 where the event is an error."""
    e = t(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("v")))).alias("steps"))
    return e.select("user_id", F.aggregate("steps", F.lit(0).cast("long"), lambda acc, x: F.when(x["event_type"] == "error", F.lit(0).cast("long")).otherwise(acc + x["v"])).alias("x"))


def t03_relations(s, d):
    a = t(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).alias("x"), (F.col("n_nationkey") / 5).cast("int").alias("y"))
    b = a.select(*[F.col(c).alias(c + "_b") for c in a.columns])
    h = F.when(F.col("x") < F.col("x_b"), "left").when(F.col("x") > F.col("x_b"), "right").otherwise("aligned")
    v = F.when(F.col("y") < F.col("y_b"), "below").when(F.col("y") > F.col("y_b"), "above").otherwise("aligned")
    return a.join(b, F.col("n_nationkey") < F.col("n_nationkey_b")).select("n_nationkey", "n_nationkey_b", h.alias("h"), v.alias("v"), (F.abs(F.col("x") - F.col("x_b")) + F.abs(F.col("y") - F.col("y_b"))).alias("dist"))


def t05_entailed(s, d):
    """Whether x < y holds in all worlds 0..5 with x < z and z < y."""
    n = lambda c: s.range(6).select(F.col("id").alias(c))
    w = n("x").crossJoin(n("y")).crossJoin(n("z")).filter("x < z AND z < y")
    return w.agg((F.min(F.expr("x < y").cast("int")) == 1).alias("less"), (F.min(F.expr("z - x < 3").cast("int")) == 1).alias("near"))


def t07_last_box(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("box"))


def t08_inverse(s, d):
    return t07_last_box(s, d).groupBy("box").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("user_id")), lambda u: u.cast("string")), ",").alias("users"))


def t09_unique(s, d):
    return t(s, d, "part").withColumn("n", F.count("*").over(Window.partitionBy("p_brand", "p_size"))).filter("n = 1").select("p_partkey", "p_brand", "p_size")


def t12_minimal_np(s, d):
    p = t(s, d, "part")
    n = lambda *c: F.count("*").over(Window.partitionBy(*c))
    return p.select("p_partkey", F.when(n("p_brand") == 1, F.col("p_brand")).when(n("p_brand", "p_size") == 1, F.concat_ws(" ", "p_brand", "p_size")).when(n("p_brand", "p_size", "p_type") == 1, F.concat_ws(" ", "p_brand", "p_size", "p_type")).alias("np"))


def t11_winograd(s, d):
    """For each pair of neighbouring parts, the larger and the smaller one, ties left out."""
    p = t(s, d, "part").select("p_partkey", "p_size")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_size").alias("size_b"))
    return p.join(q, "p_partkey").filter("p_size <> size_b").select("p_partkey", F.when(F.col("p_size") > F.col("size_b"), F.col("p_partkey")).otherwise(F.col("p_partkey") + 1).alias("larger"))


def t13_pronoun(s, d):
    """Events whose user also had the event before, and no other user of that type did: a pronoun would do."""
    e = t(s, d, "events").select("event_id", "user_id", "event_type")
    b = e.select((F.col("event_id") + 1).alias("event_id"), F.col("user_id").alias("u0"), F.col("event_type").alias("t0"))
    return e.join(b, "event_id").filter("user_id = u0 AND event_type <> t0").select("event_id", "user_id")


# constraints ----------------------------------------------------------
def c08_complement(s, d):
    """Negative facts: pairs of nation and segment without a customer."""
    c = t(s, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    grid = t(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")).join(F.broadcast(t(s, d, "customer").select("c_mktsegment").distinct()))
    return grid.join(c, ["c_nationkey", "c_mktsegment"], "left_anti")


def c11_plan_parse(s, d):
    """"a(x,y)" as "(a x y)"."""
    return t(s, d, "nation").select("n_nationkey", F.regexp_replace(F.concat(F.lit("move("), F.col("n_name"), F.lit(","), F.col("n_regionkey").cast("string"), F.lit(")")), r"^(\w+)\(([^,]*),([^)]*)\)$", r"($1 $2 $3)").alias("step"))


def queries() -> dict:
    own = {n: f for n, f in globals().items() if n[:1] in "kbtc" and n[1:3].isdigit()}
    own["k04_compose"] = lambda s, d: k.composition(s, 3)
    own["k05_converse"] = lambda s, d: k.converse(s, 3)
    return own


def _case_allen() -> str:
    sign = lambda a, b: f"sign({a} - {b})"
    tests = [f"WHEN {sign('a0', 'b0')} = {w[0]} AND {sign('a0', 'b1')} = {w[1]} AND {sign('a1', 'b0')} = {w[2]} AND {sign('a1', 'b1')} = {w[3]} THEN '{n}'" for n, w in k.ALLEN.items()]
    return "CASE " + " ".join(tests) + " END"


_SPANS = "WITH x AS (SELECT l_orderkey, min(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))) AS a0, max(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))) + 1 AS a1 FROM lineitem GROUP BY 1), y AS (SELECT x.l_orderkey, x.a0, x.a1, z.a0 AS b0, z.a1 AS b1 FROM x JOIN x z ON z.l_orderkey = x.l_orderkey + 1) "
_JOINT = "WITH j AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), cpt AS (SELECT l_returnflag, l_linestatus, sum(n) / sum(sum(n)) OVER (PARTITION BY l_returnflag) AS p FROM j GROUP BY 1, 2), prior AS (SELECT l_returnflag, sum(n) / sum(sum(n)) OVER () AS q FROM j GROUP BY 1) "
_INT = "WITH v AS (SELECT CAST(i AS INT) AS x FROM range(-3, 4) r(i)), iv AS (SELECT p.x AS s, q.x AS e FROM v p JOIN v q ON p.x < q.x), "


def oracle_sql() -> dict[str, str]:
    case = _case_allen()
    rel = lambda a, b: case.replace("a0", f"{a}.s").replace("a1", f"{a}.e").replace("b0", f"{b}.s").replace("b1", f"{b}.e")
    return {
        "k01_allen": _SPANS + f"SELECT l_orderkey, {case} AS rel FROM y",
        "k02_rcc8": _SPANS + "SELECT l_orderkey, CASE WHEN a1 < b0 OR b1 < a0 THEN 'DC' WHEN a1 = b0 OR b1 = a0 THEN 'EC' WHEN a0 = b0 AND a1 = b1 THEN 'EQ' WHEN a0 >= b0 AND a1 <= b1 THEN CASE WHEN a0 = b0 OR a1 = b1 THEN 'TPP' ELSE 'NTPP' END WHEN a0 <= b0 AND a1 >= b1 THEN CASE WHEN a0 = b0 OR a1 = b1 THEN 'TPPi' ELSE 'NTPPi' END ELSE 'PO' END AS rel FROM y",
        "k03_cardinal": _SPANS + "SELECT l_orderkey, (CASE WHEN a1 <= b0 THEN 'W' WHEN b1 <= a0 THEN 'E' ELSE 'M' END) || (CASE WHEN a1 <= b1 - b0 THEN 'S' WHEN b1 <= a1 - a0 THEN 'N' ELSE 'M' END) AS rel FROM y",
        "k04_compose": _INT + f"ab AS (SELECT a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, {rel('a', 'b')} AS r FROM iv a, iv b) SELECT DISTINCT x.r AS r1, y.r AS r2, z.r AS r3 FROM ab x JOIN ab y ON x.s2 = y.s1 AND x.e2 = y.e1 JOIN ab z ON z.s1 = x.s1 AND z.e1 = x.e1 AND z.s2 = y.s2 AND z.e2 = y.e2",
        "k05_converse": _INT + f"ab AS (SELECT a.s AS s1, {rel('a', 'b')} AS r, {rel('b', 'a')} AS c FROM iv a, iv b) SELECT DISTINCT r AS rel, c AS converse FROM ab",
        "k06_product": "SELECT a.n AS a, b.n AS b FROM (VALUES " + ", ".join(f"('{n}')" for n in k.ALLEN) + ") a(n), (VALUES " + ", ".join(f"('{n}')" for n in k.ALLEN) + ") b(n)",
        "b01_noisy_or": "WITH r AS (SELECT user_id, event_type, count(*) / 100.0 AS p FROM events GROUP BY 1, 2) SELECT user_id, round(1 - 0.95 * product(1 - least(p, 1.0)), 6) AS p FROM r GROUP BY 1",
        "b01_noisy_and": "WITH r AS (SELECT user_id, event_type, count(*) / 100.0 AS p FROM events GROUP BY 1, 2) SELECT user_id, round(product(least(p, 1.0)), 8) AS p FROM r GROUP BY 1",
        "b02_noisy_max": "WITH n AS (SELECT event_type, CAST(((CAST(floor(value) AS BIGINT) % 3) + 3) % 3 AS INT) AS level, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2), g AS (SELECT e.event_type, CAST(l.i AS INT) AS level, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT event_type FROM n) e CROSS JOIN range(3) l(i) LEFT JOIN n ON n.event_type = e.event_type AND n.level = l.i), c AS (SELECT event_type, level, sum(n) OVER (PARTITION BY event_type ORDER BY level) / sum(n) OVER (PARTITION BY event_type) AS c FROM g), m AS (SELECT level, product(c) AS c FROM c GROUP BY 1) SELECT level, round(c - coalesce(lag(c) OVER (ORDER BY level), 0), 6) AS p FROM m",
        "b04_largest_remainder": "WITH c AS (SELECT event_type, count(*) * 100.0 / sum(count(*)) OVER () AS x FROM events GROUP BY 1), f AS (SELECT event_type, floor(x) AS f, x - floor(x) AS r FROM c), k AS (SELECT *, row_number() OVER (ORDER BY round(r, 9) DESC, event_type) AS k, 100 - sum(f) OVER () AS rest FROM f) SELECT event_type, CAST(f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS pct FROM k",
        "b05_product": _JOINT + "SELECT l_returnflag, l_linestatus, round(p * q, 6) AS p FROM cpt JOIN prior USING (l_returnflag)",
        "b06_marginal": _JOINT + "SELECT l_linestatus, round(sum(p * q), 6) AS p FROM cpt JOIN prior USING (l_returnflag) GROUP BY 1",
        "b07_evidence": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1",
        "b08_posterior": "SELECT l_returnflag, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1",
        "b10_elimination": _JOINT + ", pl AS (SELECT l_returnflag, l_linenumber, sum(n) / sum(sum(n)) OVER (PARTITION BY l_returnflag) AS r FROM j GROUP BY 1, 2), m AS (SELECT l_linenumber, sum(p * q * r) AS x FROM cpt JOIN prior USING (l_returnflag) JOIN pl USING (l_returnflag) WHERE l_linestatus = 'F' GROUP BY 1) SELECT l_linenumber, round(x / sum(x) OVER (), 6) AS p FROM m",
        "b11_do": _JOINT + "SELECT l_linestatus, round(sum(p), 6) AS p FROM cpt WHERE l_returnflag = 'R' GROUP BY 1",
        "t01_moves": "SELECT event_id, user_id, CAST(sum(CAST(floor(coalesce(value, 0)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS x FROM events",
        "t01_fold": "WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), z AS (SELECT user_id, coalesce(max(k) FILTER (WHERE event_type = 'error'), 0) AS k0 FROM o GROUP BY 1) SELECT o.user_id, CAST(coalesce(sum(CAST(floor(coalesce(value, 0)) AS BIGINT)) FILTER (WHERE k > k0), 0) AS BIGINT) AS x FROM o JOIN z ON o.user_id = z.user_id GROUP BY 1",
        "t03_relations": "WITH a AS (SELECT n_nationkey AS k, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation) SELECT a.k AS n_nationkey, b.k AS n_nationkey_b, CASE WHEN a.x < b.x THEN 'left' WHEN a.x > b.x THEN 'right' ELSE 'aligned' END AS h, CASE WHEN a.y < b.y THEN 'below' WHEN a.y > b.y THEN 'above' ELSE 'aligned' END AS v, abs(a.x - b.x) + abs(a.y - b.y) AS dist FROM a JOIN a b ON a.k < b.k",
        "t05_entailed": "SELECT bool_and(x.i < y.i) AS less, bool_and(z.i - x.i < 3) AS near FROM range(6) x(i), range(6) y(i), range(6) z(i) WHERE x.i < z.i AND z.i < y.i",
        "t07_last_box": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS box FROM events GROUP BY 1",
        "t08_inverse": "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS box FROM events GROUP BY 1) SELECT box, count(*) AS n, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS users FROM l GROUP BY 1",
        "t09_unique": "SELECT p_partkey, p_brand, p_size FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part) WHERE n = 1",
        "t11_winograd": "SELECT p.p_partkey, CASE WHEN p.p_size > q.p_size THEN p.p_partkey ELSE q.p_partkey END AS larger FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1 WHERE p.p_size <> q.p_size",
        "t12_minimal_np": "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) = 1 THEN p_brand WHEN count(*) OVER (PARTITION BY p_brand, p_size) = 1 THEN p_brand || ' ' || p_size WHEN count(*) OVER (PARTITION BY p_brand, p_size, p_type) = 1 THEN p_brand || ' ' || p_size || ' ' || p_type END AS np FROM part",
        "t13_pronoun": "SELECT a.event_id, a.user_id FROM events a JOIN events b ON b.event_id = a.event_id - 1 WHERE a.user_id = b.user_id AND a.event_type <> b.event_type",
        "c08_complement": "SELECT n_nationkey AS c_nationkey, m.c_mktsegment FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) m WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n_nationkey AND c.c_mktsegment = m.c_mktsegment)",
        "c11_plan_parse": "SELECT n_nationkey, '(move ' || n_name || ' ' || n_regionkey || ')' AS step FROM nation",
    }
