"""Tables of generated problems and what is asked of them: planning, constraints, networks.

Each row of ``customer`` stands for a problem.  All draws are md5 numbers of
the problem and the place of the draw, so the same problems come out in SQL.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import bayes, calculi, constraints, planning
from loomwork.scratch import materialise
from loomwork.scratch import table as t


def draw(*parts: Column | str | int) -> Column:
    """A number below 2**32 that depends on the parts only; texts name columns."""
    cols = [F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def _shift(x: Column, n: Column) -> Column:
    """Shifted left by as many bits as another column says."""
    return F.call_function("shiftleft", x, n)


def _d(*parts: object) -> str:
    """The same draw in SQL."""
    return f"CAST('0x' || substr(md5({' || chr(58) || '.join(f'CAST({p} AS VARCHAR)' for p in parts)}), 1, 8) AS BIGINT)"


# planning -------------------------------------------------------------
DOMAINS, FLUENTS, ACTIONS = 200, 3, 3


def fluents(s, d) -> DataFrame:
    """(dom, f, arity, off): fluents of at most two arguments over two objects, and the number of the first fact of each."""
    dom = t(s, d, "customer").select((F.col("c_custkey") % DOMAINS).alias("dom")).distinct()
    one = dom.select("dom", F.explode(F.sequence(F.lit(0), F.lit(FLUENTS - 1))).alias("f")).withColumn("arity", (draw("dom", "f", 1) % 3).cast("int"))
    w = F.sum(_shift(F.lit(1), F.col("arity"))).over(Window.partitionBy("dom").orderBy("f").rowsBetween(Window.unboundedPreceding, -1))
    return one.withColumn("off", F.coalesce(w, F.lit(0)).cast("int"))


def c06_domain(s, d):
    """Literals of the actions of a domain: each action may ask for a fluent and set it, with its arguments in one of two orders."""
    lit = fluents(s, d).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(ACTIONS - 1)))).filter(draw("dom", "a", "f", 2) % 10 < 7)
    bit = draw("dom", "a", "f", 4) % 2
    asks = F.when(draw("dom", "a", "f", 5) % 10 < 8, bit)
    sets = F.when(draw("dom", "a", "f", 6) % 10 == 0, draw("dom", "a", "f", 7) % 2).otherwise(1 - bit)
    return lit.select("dom", "a", "f", "arity", "off", (draw("dom", "a", "f", 3) % 2).cast("int").alias("turned"), asks.cast("int").alias("asks"), sets.cast("int").alias("sets"))


def _place(x: Column, y: Column) -> Column:
    """Number of the fact that a fluent is for two objects."""
    a, b = F.when(F.col("turned") == 1, y).otherwise(x), F.when(F.col("turned") == 1, x).otherwise(y)
    return F.col("off") + F.when(F.col("arity") == 0, 0).when(F.col("arity") == 1, a).otherwise(a * 2 + b)


def ground_actions(s, d) -> DataFrame:
    """(dom, no, pre, neg, add, del): every action for every pair of objects, as bits."""
    g = c06_domain(s, d).withColumn("x", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("y", F.explode(F.array(F.lit(0), F.lit(1))))
    bit = _shift(F.lit(1).cast("long"), _place(F.col("x"), F.col("y")).cast("int"))
    of = lambda cond: F.bit_or(F.when(cond, bit).otherwise(F.lit(0).cast("long")))
    g = g.groupBy("dom", (F.col("a") * 4 + F.col("x") * 2 + F.col("y")).cast("int").alias("no"))
    return g.agg(of(F.col("asks") == 1).alias("pre"), of(F.col("asks") == 0).alias("neg"), of(F.col("sets") == 1).alias("add"), of(F.col("sets") == 0).alias("del"))


def c07_problem(s, d):
    """(id, dom, init, want, avoid): facts hold at first at a rate of the problem's own; two goals, one in six negated."""
    p = t(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % DOMAINS).alias("dom"))
    f = fluents(s, d).withColumn("size", _shift(F.lit(1), F.col("arity")))
    facts = p.join(f, "dom").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).withColumn("at", F.col("off") + F.col("k"))
    rate = F.pow((draw("id", 10) % 1000) / 1000.0, F.lit(2.5))
    one = _shift(F.lit(1).cast("long"), F.col("at"))
    init = facts.groupBy("id", "dom").agg(F.bit_or(F.when((draw("id", "at", 11) % 1000) / 1000.0 < rate, one).otherwise(F.lit(0).cast("long"))).alias("init"))
    goals = p.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("f", (draw("id", "g", 12) % FLUENTS).cast("int")).join(f, ["dom", "f"])
    goals = goals.withColumn("at", F.col("off") + (draw("id", "g", 13) % F.col("size")).cast("int")).withColumn("no", draw("id", "g", 14) % 6 == 0)
    goals = goals.groupBy("id", "at").agg(F.min_by("no", "g").alias("no"))
    goals = goals.groupBy("id").agg(F.bit_or(F.when(~F.col("no"), one).otherwise(F.lit(0).cast("long"))).alias("want"), F.bit_or(F.when(F.col("no"), one).otherwise(F.lit(0).cast("long"))).alias("avoid"))
    return init.join(goals, "id")


def _problems(s, d) -> DataFrame:
    own = ground_actions(s, d).groupBy("dom").agg(F.array_sort(F.collect_list(F.struct("no", "pre", "neg", "add", "del"))).alias("actions"))
    return c07_problem(s, d).join(own, "dom", "left")


def c09_plan(s, d):
    """The cheapest plan of each problem: fewest steps, then the least sum of action numbers, then the first in order."""
    found = planning.plans(_problems(s, d).repartition("id"))
    return found.select("id", "cost", F.concat_ws(" ", F.transform("plan", lambda a: F.lpad(a.cast("string"), 2, "0"))).alias("plan"))


def c08_positive(s, d):
    """Actions without negative conditions, over twice as many facts."""
    return planning.without_negative(ground_actions(s, d), 12).select("dom", "no", "pre", "add", F.col("del").alias("clear"))


def _candidates(s, d) -> DataFrame:
    """Plans as an answer would give them: right, cut short, turned round, with an unknown action, or empty."""
    probs = materialise(_problems(s, d), "problems")
    found = planning.plans(probs).filter("size(plan) > 0").select("id", "plan")
    kind = draw("id", 20) % 5
    changed = F.when(kind == 1, F.slice("plan", 1, F.size("plan") - 1)).when(kind == 2, F.reverse("plan")).when(kind == 3, F.concat("plan", F.array(F.lit(99)))).otherwise(F.col("plan"))
    return found.select("id", F.concat_ws("", F.transform(changed, lambda a: F.concat(F.lit("act("), a.cast("string"), F.lit(")\n")))).alias("answer")).join(probs, "id")


def c10_plan_check(s, d):
    """Plans in text, carried out step by step: 1, 0.1 or 0."""
    c = _candidates(s, d)
    steps = F.transform(F.regexp_extract_all("answer", F.lit(r"act\((\d+)\)"), F.lit(1)), lambda n: F.get(F.filter("actions", lambda a: a["no"] == n.cast("int")), F.lit(0)))
    return c.select("id", "answer", planning.plan_score(F.col("init"), F.col("want"), F.col("avoid"), steps).alias("score"))


def z27_plan(s, d):
    """The score of each plan with a word for it."""
    return c10_plan_check(s, d).select("id", "score", F.when(F.col("score") == 1, "valid").when(F.col("score") > 0, "bad_semantics").otherwise("plan parsing error").alias("tag"))


def c12_plan_states(s, d):
    """The facts that hold after each step of the best plan."""
    probs = materialise(_problems(s, d), "problems")
    found = planning.plans(probs).filter("size(plan) > 0").join(probs, "id").withColumn("step", F.explode(F.sequence(F.lit(1), F.size("plan"))))
    taken = F.transform(F.slice("plan", F.lit(1), F.col("step")), lambda n: F.get(F.filter("actions", lambda a: a["no"] == n), F.lit(0)))
    return found.select("id", "step", planning.states_along(F.col("init"), taken)["state"].alias("state"))


# constraints ----------------------------------------------------------
CONSTRAINTS = 3


def c01_constraints(s, d):
    """(id, k, kind, idx, coeffs, op, rhs, mod): constraints around a hidden witness, so most problems can be solved."""
    p = t(s, d, "customer").select(F.col("c_custkey").alias("id")).withColumn("n", (3 + draw("id", 30) % 2).cast("int"))
    bound = lambda i: (2 + draw("id", i, 31) % 4).cast("int")
    hidden = lambda i: (draw("id", i, 32) % (2 + draw("id", i, 31) % 4 + 1)).cast("int")
    k = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(CONSTRAINTS - 1))))
    v = k.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).filter((draw("id", "k", "i", 33) % 2 == 0) | (F.col("i") == draw("id", "k", 34) % F.col("n")))
    v = v.withColumn("c", F.when(draw("id", "k", 35) % 10 < 6, "lin").when(draw("id", "k", 35) % 10 < 8, "mod").otherwise("alldiff"))
    a = F.when(F.col("c") == "mod", 1 + draw("id", "k", "i", 36) % 3).otherwise(F.array(*[F.lit(x) for x in (-3, -2, -1, 1, 2, 3)])[(draw("id", "k", "i", 36) % 6).cast("int")]).cast("int")
    v = v.withColumn("a", F.when(F.col("c") != "alldiff", a)).withColumn("w", hidden("i"))
    rows = v.groupBy("id", "n", "k", "c").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("s"), F.sum(F.col("a") * F.col("w")).cast("int").alias("total"))
    op = F.when(F.col("c") == "lin", F.element_at(F.array(*[F.lit(x) for x in ("==", "!=", "<=", ">=")]), (draw("id", "k", 37) % 4 + 1).cast("int")))
    slack = (draw("id", "k", 38) % 3).cast("int")
    mod = F.when(F.col("c") == "mod", (2 + draw("id", "k", 39) % 4).cast("int"))
    # one linear constraint in eight is wrong on purpose: some problems have no solution
    off = F.when(draw("id", "k", 40) % 8 == 0, 40).otherwise(0)
    rhs = F.when(F.col("c") == "mod", F.pmod("total", mod)).when(op == "!=", F.col("total") + slack + 1).when(op == "<=", F.col("total") + slack - off).when(op == ">=", F.col("total") - slack + off).when(op == "==", F.col("total") + off)
    return rows.select("id", "k", F.col("c").alias("kind"), F.transform("s", lambda x: x["i"]).alias("idx"), F.when(F.col("c") != "alldiff", F.transform("s", lambda x: x["a"])).alias("coeffs"), op.alias("op"), rhs.cast("int").alias("rhs"), mod.alias("mod")).withColumn("bounds", F.transform(F.sequence(F.lit(0), (3 + draw("id", 30) % 2).cast("int") - 1), lambda i: (2 + draw("id", i, 31) % 4).cast("int")))


def _csp(s, d) -> DataFrame:
    grouped = c01_constraints(s, d).groupBy("id", "bounds").agg(F.array_sort(F.collect_list(F.struct("kind", "idx", "coeffs", "op", "rhs", "mod"))).alias("constraints"))
    return materialise(grouped, "constraints").repartition("id")


def c01_text(s, d):
    return c01_constraints(s, d).select("id", "k", constraints.constraint_text(F.struct("kind", "idx", "coeffs", "op", "rhs", "mod")).alias("text"))


def c02_solve_all(s, d):
    return constraints.solutions(_csp(s, d)).select("id", F.concat_ws(",", F.transform("x", lambda v: v.cast("string"))).alias("x"))


def c03_solve_min(s, d):
    return constraints.solutions(_csp(s, d)).groupBy("id").agg(F.min("x").alias("m")).select("id", F.concat_ws(",", F.transform("m", lambda v: v.cast("string"))).alias("x"))


def c04_answers(s, d):
    return constraints.answers(_csp(s, d))


def c05_structure(s, d):
    """Neighbours of the variables of a problem: all, a random graph, a grid of two columns, or clusters; none alone."""
    p = t(s, d, "customer").select(F.col("c_custkey").alias("id")).withColumn("n", (4 + draw("id", 50) % 3).cast("int")).withColumn("mode", (draw("id", 51) % 4).cast("int"))
    e = p.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("n") - 2))).withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.col("n") - 1)))
    chance = draw("id", "a", "b", 52) % 100
    same = draw("id", "a", 53) % 2 == draw("id", "b", 53) % 2
    grid = ((F.col("b") == F.col("a") + 1) & (F.col("a") % 2 == 0)) | (F.col("b") == F.col("a") + 2)
    kept = F.when(F.col("mode") == 0, F.lit(True)).when(F.col("mode") == 1, chance < 40).when(F.col("mode") == 2, grid).otherwise(F.when(same, chance < 80).otherwise(chance < 10))
    links = e.filter(kept).select("id", "n", "a", "b")
    ends = links.select("id", F.col("a").alias("v")).union(links.select("id", "b"))
    alone = p.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).join(ends, ["id", "v"], "left_anti")
    other = ((F.col("v") + 1 + draw("id", "v", 54) % (F.col("n") - 1)) % F.col("n")).cast("int")
    added = alone.select("id", "n", F.least("v", other).alias("a"), F.greatest("v", other).alias("b"))
    return links.union(added).select("id", "a", "b").distinct()


def t05_follows(s, d):
    """Whether a relation of two of three things on a line holds in all places 0 to 3 that some facts leave; null where they leave none."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 2), (0, 2))])
    x = t(s, d, "customer").select(F.col("c_custkey").alias("id")).withColumn("f", F.explode(F.filter(F.sequence(F.lit(0), F.lit(1)), lambda f: (f == 0) | (draw("id", 80) % 3 > 0))))
    fact = F.element_at(pairs, (draw("id", "f", 81) % 3 + 1).cast("int"))
    op = F.element_at(F.array(*[F.lit(o) for o in ("<=", "==", ">=")]), (draw("id", "f", 82) % 3 + 1).cast("int"))
    # "left of" is at most one less, "right of" at least one more
    rhs = F.when(op == "<=", -1).when(op == ">=", 1).otherwise(0)
    one = F.struct(F.lit("lin").alias("kind"), F.array(fact["a"], fact["b"]).alias("idx"), F.array(F.lit(1), F.lit(-1)).alias("coeffs"), op.alias("op"), rhs.alias("rhs"), F.lit(None).cast("int").alias("mod"))
    worlds = constraints.solutions(x.groupBy("id").agg(F.collect_list(one).alias("constraints")).withColumn("bounds", F.array(*[F.lit(3)] * 3)))
    asked = F.element_at(pairs, (draw("id", 83) % 3 + 1).cast("int"))
    per = worlds.groupBy("id").agg(F.bool_and(F.element_at("x", asked["a"] + 1) < F.element_at("x", asked["b"] + 1)).alias("follows"))
    return t(s, d, "customer").select(F.col("c_custkey").alias("id")).join(per, "id", "left")


def k02_boxes(s, d):
    """The region relation of two boxes, each of two intervals."""
    n = lambda k, m: (draw("id", 85, k) % m).cast("int")
    x = t(s, d, "customer").select(F.col("c_custkey").alias("id"))
    for k, name in enumerate(("ax", "ay", "bx", "by")):
        x = x.withColumn(f"{name}0", n(2 * k, 4)).withColumn(f"{name}1", F.col(f"{name}0") + 1 + n(2 * k + 1, 3))
    return x.select("id", *x.columns[1:], calculi.rcc8_box(*[F.col(c) for c in ("ax0", "ax1", "ay0", "ay1", "bx0", "bx1", "by0", "by1")]).alias("rel"))


# networks -------------------------------------------------------------
VARIABLES = 5


def network_rows(s, d) -> DataFrame:
    """(id, var, parents, states, p): binary networks of five variables with at most two parents each; every third table with two is a noisy OR."""
    v = t(s, d, "customer").select(F.col("c_custkey").alias("id")).withColumn("var", F.explode(F.sequence(F.lit(0), F.lit(VARIABLES - 1))))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(VARIABLES - 2)), lambda j: (j < F.col("var")) & (draw("id", "var", j, 60) % 100 < 60))
    v = v.withColumn("parents", F.slice(chosen, 1, 2))
    n = F.size("parents")
    rate = lambda k: (1 + draw("id", "var", k, 61) % 9) / 10.0
    noisy = (n == 2) & (draw("id", "var", 62) % 3 == 0)
    fourth = F.when(noisy & (F.col("k") == 3), 1 - (1 - rate(F.lit(1))) * (1 - rate(F.lit(2))) / (1 - rate(F.lit(0)))).otherwise(rate(F.col("k")))
    rows = v.withColumn("k", F.explode(F.sequence(F.lit(0), _shift(F.lit(1), n) - 1))).withColumn("one", F.least(F.greatest(fourth, F.lit(0.0)), F.lit(1.0)))
    g = rows.groupBy("id", "var", "parents").agg(F.array_sort(F.collect_list(F.struct("k", "one"))).alias("rows"))
    return g.select("id", "var", "parents", F.lit(2).alias("states"), F.flatten(F.transform("rows", lambda r: F.array(1 - r["one"], r["one"]))).alias("p"))


def b12_questions(s, d):
    """A question per network: target, evidence, and in half of them a variable that is set; all different."""
    q = t(s, d, "customer").select(F.col("c_custkey").alias("id")).withColumn("target", (draw("id", 70) % VARIABLES).cast("int"))
    q = q.withColumn("given", ((F.col("target") + 1 + draw("id", 71) % 2) % VARIABLES).cast("int")).withColumn("given_state", (draw("id", 72) % 2).cast("int"))
    some = draw("id", 73) % 2 == 0
    q = q.withColumn("set", F.when(some, ((F.col("target") + 3 + draw("id", 74) % 2) % VARIABLES).cast("int"))).withColumn("set_state", F.when(some, (draw("id", 75) % 2).cast("int")))
    return q


def _answers(s, d) -> DataFrame:
    return bayes.queries_answered(bayes.collect_nodes(network_rows(s, d)).join(b12_questions(s, d), "id"))


def b10_posteriors(s, d):
    """P(target = 1 | evidence, set) of every network, by elimination in min-fill order."""
    return _answers(s, d).select("id", F.round(F.element_at("p", 2), 6).alias("p"))


def b09_orders(s, d):
    """The order in which the variables of each question are eliminated."""
    return _answers(s, d).select("id", F.concat_ws(" ", F.transform("elimination", lambda v: v.cast("string"))).alias("elimination"))


def b15_proofs(s, d):
    return _answers(s, d).select("id", "proof")


def b13_compact(s, d):
    """Tables that are a noisy OR, as its leak and strengths."""
    c = bayes.compact(bayes.collect_nodes(network_rows(s, d)).filter("exists(nodes, n -> size(n.parents) = 2)"), 0.2)
    return c.select("id", "var", F.round("leak", 6).alias("leak"), F.round(F.get("strengths", F.lit(0)), 6).alias("s0"), F.round(F.get("strengths", F.lit(1)), 6).alias("s1"))


def b14_bif(s, d):
    """Networks written as text, read back and put out as rows."""

    def both(batches):
        for batch in batches:
            rows = [(key, n["var"], len(n["parents"]), k // 2, n["p"][k + 1]) for key, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n in bayes.read_bif(bayes.write_bif(nodes)) for k in range(0, len(n["p"]), 2)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, x) for c, x in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()], strict=True)], names=["id", "var", "parents", "k", "p"])

    nets = bayes.collect_nodes(network_rows(s, d))
    return nets.mapInArrow(both, "id long, var int, parents int, k int, p double").select("id", "var", "parents", "k", F.round("p", 9).alias("p"))


def queries() -> dict:
    return {n: f for n, f in globals().items() if n[:1] in "bcktz" and n[1:3].isdigit()}


_C = "CAST(c_custkey AS BIGINT)"
_FLUENTS = f"""
fl AS (SELECT dom, CAST(f AS INT) AS f, CAST({_d('dom', 'f', 1)} % 3 AS INT) AS arity FROM (SELECT DISTINCT c_custkey % {DOMAINS} AS dom FROM customer), range({FLUENTS}) r(f)),
fo AS (SELECT *, CAST(coalesce(sum(1 << arity) OVER (PARTITION BY dom ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS off FROM fl)"""
_LITERALS = _FLUENTS + f""",
li AS (
  SELECT dom, CAST(a AS INT) AS a, f, arity, off, CAST({_d('dom', 'a', 'f', 3)} % 2 AS INT) AS turned,
    CASE WHEN {_d('dom', 'a', 'f', 5)} % 10 < 8 THEN CAST({_d('dom', 'a', 'f', 4)} % 2 AS INT) END AS asks,
    CAST(CASE WHEN {_d('dom', 'a', 'f', 6)} % 10 = 0 THEN {_d('dom', 'a', 'f', 7)} % 2 ELSE 1 - {_d('dom', 'a', 'f', 4)} % 2 END AS INT) AS sets
  FROM fo, range({ACTIONS}) r(a) WHERE {_d('dom', 'a', 'f', 2)} % 10 < 7)"""
_GROUND = _LITERALS + """,
gb AS (
  SELECT dom, CAST(a * 4 + x * 2 + y AS INT) AS no, asks, sets,
    CAST(1 AS BIGINT) << CAST(off + CASE arity WHEN 0 THEN 0 WHEN 1 THEN (CASE turned WHEN 1 THEN y ELSE x END) ELSE (CASE turned WHEN 1 THEN y * 2 + x ELSE x * 2 + y END) END AS BIGINT) AS bit
  FROM li, range(2) r(x), range(2) q(y)),
ga AS (SELECT dom, no, coalesce(bit_or(bit) FILTER (WHERE asks = 1), 0) AS pre, coalesce(bit_or(bit) FILTER (WHERE asks = 0), 0) AS neg, coalesce(bit_or(bit) FILTER (WHERE sets = 1), 0) AS ad, coalesce(bit_or(bit) FILTER (WHERE sets = 0), 0) AS cl FROM gb GROUP BY 1, 2)"""
_PROBLEMS = f""",
pr AS (SELECT {_C} AS id, c_custkey % {DOMAINS} AS dom FROM customer),
ini AS (
  SELECT id, dom, bit_or(CASE WHEN ({_d('id', 'fa', 11)} % 1000) / 1000.0 < pow(({_d('id', 10)} % 1000) / 1000.0, 2.5) THEN CAST(1 AS BIGINT) << fa ELSE 0 END) AS init
  FROM (SELECT pr.id, pr.dom, CAST(fo.off + k AS BIGINT) AS fa FROM pr JOIN fo USING (dom), range(4) r(k) WHERE k < (1 << fo.arity)) GROUP BY 1, 2),
go1 AS (
  SELECT id, CAST(off + {_d('id', 'g', 13)} % (1 << arity) AS BIGINT) AS fa, g, {_d('id', 'g', 14)} % 6 = 0 AS neg
  FROM (SELECT id, dom, CAST(g AS INT) AS g, CAST({_d('id', 'g', 12)} % {FLUENTS} AS INT) AS f FROM pr, range(2) r(g)) JOIN fo USING (dom, f)),
go AS (SELECT id, coalesce(bit_or(CAST(1 AS BIGINT) << fa) FILTER (WHERE NOT neg), 0) AS want, coalesce(bit_or(CAST(1 AS BIGINT) << fa) FILTER (WHERE neg), 0) AS avoid FROM (SELECT id, fa, arg_min(neg, g) AS neg FROM go1 GROUP BY 1, 2) GROUP BY 1),
ps AS (SELECT * FROM ini JOIN go USING (id))"""
#: Breadth first: every level keeps the cheapest way to each of its states; longer than all states no shortest plan is.
_SEARCH = """,
se AS (
  SELECT id, dom, init AS state, CAST(0 AS BIGINT) AS cost, '' AS plan, 0 AS depth, want, avoid, (init & want) = want AND (init & avoid) = 0 AS done FROM ps
  UNION ALL
  SELECT id, dom, state, cost, plan, depth, want, avoid, bool_or((state & want) = want AND (state & avoid) = 0) OVER (PARTITION BY id) AS done FROM (
    SELECT *, row_number() OVER (PARTITION BY id, state ORDER BY cost, plan) AS rn FROM (
      SELECT se.id, se.dom, (se.state & ~ga.cl) | ga.ad AS state, se.cost + 10000 + ga.no AS cost, trim(se.plan || ' ' || lpad(CAST(ga.no AS VARCHAR), 2, '0')) AS plan, se.depth + 1 AS depth, se.want, se.avoid
      FROM se JOIN ga ON ga.dom = se.dom AND (se.state & ga.pre) = ga.pre AND (se.state & ga.neg) = 0 WHERE NOT se.done AND se.depth < 20 AND ((se.state & ~ga.cl) | ga.ad) <> se.state)) WHERE rn = 1),
best AS (SELECT id, min(cost) AS cost, arg_min(plan, (cost, plan)) AS plan FROM se WHERE (state & want) = want AND (state & avoid) = 0 GROUP BY 1)"""
_CHECKED = f""",
an AS (
  SELECT ps.id, ps.dom, init, ps.want, ps.avoid, CASE {_d('id', 20)} % 5 WHEN 1 THEN p[1:len(p) - 1] WHEN 2 THEN list_reverse(p) WHEN 3 THEN list_append(p, '99') ELSE p END AS p
  FROM (SELECT id, string_split(plan, ' ') AS p FROM best WHERE plan <> '') JOIN ps USING (id)),
st AS (
  SELECT id, dom, want, avoid, p, 0 AS k, init AS state, true AS ok, len(p) > 0 AS known FROM an
  UNION ALL SELECT st.id, st.dom, want, avoid, p, k + 1, (state & ~cl) | ad, ok AND (state & pre) = pre AND (state & neg) = 0, known AND ga.no IS NOT NULL
  FROM st LEFT JOIN ga ON ga.dom = st.dom AND ga.no = CAST(p[k + 1] AS INT) WHERE k < len(p)),
sc AS (
  SELECT id, array_to_string(list_transform(p, lambda x: 'act(' || CAST(x AS INT) || ')' || chr(10)), '') AS answer,
    CASE WHEN NOT known THEN 0.0 WHEN ok AND (state & want) = want AND (state & avoid) = 0 THEN 1.0 ELSE 0.1 END::DOUBLE AS score FROM st WHERE k = len(p))"""
_CSP = f"""
pv AS (SELECT {_C} AS id, CAST(3 + {_d('c_custkey', 30)} % 2 AS INT) AS n FROM customer),
vs AS (SELECT id, n, CAST(k AS INT) AS k, CAST(i AS INT) AS i FROM pv, range({CONSTRAINTS}) r(k), range(4) q(i) WHERE i < n),
vc AS (
  SELECT *, CASE WHEN {_d('id', 'k', 35)} % 10 < 6 THEN 'lin' WHEN {_d('id', 'k', 35)} % 10 < 8 THEN 'mod' ELSE 'alldiff' END AS kind, {_d('id', 'i', 32)} % (3 + {_d('id', 'i', 31)} % 4) AS w
  FROM vs WHERE {_d('id', 'k', 'i', 33)} % 2 = 0 OR i = {_d('id', 'k', 34)} % n),
va AS (SELECT *, CASE kind WHEN 'mod' THEN 1 + {_d('id', 'k', 'i', 36)} % 3 WHEN 'lin' THEN [-3, -2, -1, 1, 2, 3][CAST({_d('id', 'k', 'i', 36)} % 6 + 1 AS INT)] END AS a FROM vc),
vt AS (SELECT id, n, k, kind, list(i ORDER BY i) AS idx, list(a ORDER BY i) AS co, sum(a * w) AS total, {_d('id', 'k', 38)} % 3 AS slack, CASE WHEN {_d('id', 'k', 40)} % 8 = 0 THEN 40 ELSE 0 END AS off,
  CASE kind WHEN 'lin' THEN ['==', '!=', '<=', '>='][CAST({_d('id', 'k', 37)} % 4 + 1 AS INT)] END AS op, CASE kind WHEN 'mod' THEN 2 + {_d('id', 'k', 39)} % 4 END AS md FROM va GROUP BY id, n, k, kind),
cs AS (SELECT *, CAST(CASE WHEN kind = 'mod' THEN total % md WHEN op = '!=' THEN total + slack + 1 WHEN op = '<=' THEN total + slack - off WHEN op = '>=' THEN total - slack + off WHEN op = '==' THEN total + off END AS INT) AS rhs FROM vt),
xs AS (
  SELECT id, [CAST(a AS INT), CAST(b AS INT), CAST(c AS INT), CAST(e AS INT)][1:n] AS x FROM pv, range(6) ra(a), range(6) rb(b), range(6) rc(c), range(6) re(e)
  WHERE a <= 2 + {_d('id', 0, 31)} % 4 AND b <= 2 + {_d('id', 1, 31)} % 4 AND c <= 2 + {_d('id', 2, 31)} % 4 AND CASE n WHEN 4 THEN e <= 2 + {_d('id', 3, 31)} % 4 ELSE e = 0 END),
ok AS (
  SELECT xs.id, xs.x FROM xs JOIN (SELECT *, generate_series(1, len(idx)) AS js FROM cs) c ON c.id = xs.id GROUP BY xs.id, xs.x HAVING bool_and(
    CASE c.kind WHEN 'alldiff' THEN len(list_distinct(list_transform(c.idx, lambda i: xs.x[i + 1]))) = len(c.idx)
    WHEN 'mod' THEN list_sum(list_transform(c.js, lambda j: c.co[j] * xs.x[c.idx[j] + 1])) % c.md = c.rhs
    ELSE CASE c.op WHEN '==' THEN list_sum(list_transform(c.js, lambda j: c.co[j] * xs.x[c.idx[j] + 1])) = c.rhs WHEN '!=' THEN list_sum(list_transform(c.js, lambda j: c.co[j] * xs.x[c.idx[j] + 1])) <> c.rhs
      WHEN '<=' THEN list_sum(list_transform(c.js, lambda j: c.co[j] * xs.x[c.idx[j] + 1])) <= c.rhs ELSE list_sum(list_transform(c.js, lambda j: c.co[j] * xs.x[c.idx[j] + 1])) >= c.rhs END END)),
so AS (SELECT id, array_to_string(x, ',') AS x FROM ok)"""
_NETS = f"""
nv AS (SELECT {_C} AS id, CAST(v AS INT) AS var FROM customer, range({VARIABLES}) r(v)),
np AS (SELECT id, var, list_filter([0, 1, 2, 3], lambda j: j < var AND {_d('id', 'var', 'j', 60)} % 100 < 60)[1:2] AS pa FROM nv),
nr AS (
  SELECT id, var, pa, CAST(k AS INT) AS k, least(greatest(CASE WHEN k = 3 AND {_d('id', 'var', 62)} % 3 = 0
    THEN 1 - (1 - (1 + {_d('id', 'var', 1, 61)} % 9) / 10.0::DOUBLE) * (1 - (1 + {_d('id', 'var', 2, 61)} % 9) / 10.0::DOUBLE) / (1 - (1 + {_d('id', 'var', 0, 61)} % 9) / 10.0::DOUBLE)
    ELSE (1 + {_d('id', 'var', 'k', 61)} % 9) / 10.0::DOUBLE END, 0), 1) AS one
  FROM np, range(4) r(k) WHERE k < (1 << len(pa)))"""
_QUESTIONS = f"""
qa AS (SELECT {_C} AS id, CAST({_d('c_custkey', 70)} % {VARIABLES} AS INT) AS target FROM customer),
qq AS (
  SELECT id, target, CAST((target + 1 + {_d('id', 71)} % 2) % {VARIABLES} AS INT) AS given, CAST({_d('id', 72)} % 2 AS INT) AS given_state,
    CASE WHEN {_d('id', 73)} % 2 = 0 THEN CAST((target + 3 + {_d('id', 74)} % 2) % {VARIABLES} AS INT) END AS "set", CASE WHEN {_d('id', 73)} % 2 = 0 THEN CAST({_d('id', 75)} % 2 AS INT) END AS set_state FROM qa)"""


def oracle_sql() -> dict[str, str]:
    bit = lambda v: f"((m >> CAST({v} AS INT)) & 1)"
    joint = f"""
jo AS (
  SELECT nr.id, m, product(CASE WHEN qq."set" = nr.var THEN CASE WHEN {bit('nr.var')} = qq.set_state THEN 1.0 ELSE 0.0 END WHEN {bit('nr.var')} = 1 THEN one ELSE 1 - one END) AS p
  FROM nr JOIN qq USING (id), range({1 << VARIABLES}) r(m)
  WHERE k = CASE len(pa) WHEN 0 THEN 0 WHEN 1 THEN {bit('pa[1]')} ELSE {bit('pa[1]')} * 2 + {bit('pa[2]')} END GROUP BY 1, 2)"""
    text = "CASE WHEN a = 1 THEN 'x' || i WHEN a = -1 THEN '-x' || i ELSE a || '*x' || i END"
    return {
        "c06_domain": f"WITH {_LITERALS} SELECT dom, a, f, arity, off, turned, asks, sets FROM li",
        "c07_problem": f"WITH {_FLUENTS}{_PROBLEMS} SELECT id, dom, init, want, avoid FROM ps",
        "c08_positive": f"WITH {_GROUND} SELECT dom, no, pre | (neg << 12) AS pre, ad | (cl << 12) AS add, cl | (ad << 12) AS clear FROM ga",
        "c09_plan": f"WITH RECURSIVE {_GROUND}{_PROBLEMS}{_SEARCH} SELECT id, cost, coalesce(plan, '') AS plan FROM ps LEFT JOIN best USING (id)",
        "c10_plan_check": f"WITH RECURSIVE {_GROUND}{_PROBLEMS}{_SEARCH}{_CHECKED} SELECT id, coalesce(answer, '') AS answer, score FROM sc",
        "z27_plan": f"WITH RECURSIVE {_GROUND}{_PROBLEMS}{_SEARCH}{_CHECKED} SELECT id, score, CASE score WHEN 1.0 THEN 'valid' WHEN 0.1 THEN 'bad_semantics' ELSE 'plan parsing error' END AS tag FROM sc",
        "c12_plan_states": f"WITH RECURSIVE {_GROUND}{_PROBLEMS}{_SEARCH}, st AS (SELECT ps.id, ps.dom, string_split(plan, ' ') AS p, 0 AS k, init AS state FROM best JOIN ps USING (id) WHERE plan <> '' UNION ALL SELECT st.id, st.dom, p, k + 1, (state & ~cl) | ad FROM st JOIN ga ON ga.dom = st.dom AND ga.no = CAST(p[k + 1] AS INT)) SELECT id, k AS step, state FROM st WHERE k > 0",
        "c01_text": f"WITH {_CSP} SELECT id, k, CASE kind WHEN 'alldiff' THEN 'AllDifferent(' || array_to_string(list_transform(idx, lambda i: 'x' || i), ', ') || ')' WHEN 'lin' THEN replace(s, '+ -', '- ') || ' ' || op || ' ' || rhs ELSE '(' || replace(s, '+ -', '- ') || ') % ' || md || ' == ' || rhs END AS text FROM cs JOIN (SELECT id, k, string_agg({text}, ' + ' ORDER BY i) AS s FROM va GROUP BY 1, 2) USING (id, k)",
        "c05_structure": f"WITH p AS (SELECT {_C} AS id, CAST(4 + {_d('c_custkey', 50)} % 3 AS INT) AS n, {_d('c_custkey', 51)} % 4 AS mode FROM customer), v AS (SELECT id, n, mode, CAST(i AS INT) AS i FROM p, range(6) r(i) WHERE i < n), e AS (SELECT x.id, x.n, x.i AS a, y.i AS b FROM v x JOIN v y ON x.id = y.id AND x.i < y.i WHERE CASE x.mode WHEN 0 THEN true WHEN 1 THEN {_d('x.id', 'x.i', 'y.i', 52)} % 100 < 40 WHEN 2 THEN (y.i = x.i + 1 AND x.i % 2 = 0) OR y.i = x.i + 2 ELSE {_d('x.id', 'x.i', 'y.i', 52)} % 100 < CASE WHEN {_d('x.id', 'x.i', 53)} % 2 = {_d('x.id', 'y.i', 53)} % 2 THEN 80 ELSE 10 END END), l AS (SELECT id, n, i, CAST((i + 1 + {_d('id', 'i', 54)} % (n - 1)) % n AS INT) AS j FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = v.id AND (e.a = v.i OR e.b = v.i))) SELECT id, a, b FROM e UNION SELECT id, least(i, j), greatest(i, j) FROM l",
        "c02_solve_all": f"WITH {_CSP} SELECT id, x FROM so",
        "c03_solve_min": f"WITH {_CSP} SELECT id, min(x) AS x FROM so GROUP BY 1",
        "c04_answers": f"WITH {_CSP}, g AS (SELECT id, count(*) AS n, min(x) AS x, string_agg(x, ';' ORDER BY x) AS every FROM so GROUP BY 1) SELECT pv.id, CASE WHEN g.n IS NULL THEN 'UNSAT' WHEN g.n > 256 THEN 'min' ELSE 'all' END AS mode, coalesce(g.n, 0) AS n, CASE WHEN g.n IS NULL THEN 'UNSAT' WHEN g.n > 256 THEN x ELSE every END AS answer FROM pv LEFT JOIN g ON g.id = pv.id",
        "t05_follows": f"WITH ii AS (SELECT {_C} AS id FROM customer), fa AS (SELECT id, CAST(f AS INT) AS f, [[1, 2], [2, 3], [1, 3]][CAST({_d('id', 'f', 81)} % 3 + 1 AS INT)] AS p, {_d('id', 'f', 82)} % 3 AS o FROM ii, range(2) r(f) WHERE f = 0 OR {_d('id', 80)} % 3 > 0), wo AS (SELECT [x, y, z] AS w FROM range(4) a(x), range(4) b(y), range(4) c(z)), ok AS (SELECT id, w FROM fa, wo GROUP BY id, w HAVING bool_and(CASE o WHEN 0 THEN w[p[1]] < w[p[2]] WHEN 1 THEN w[p[1]] = w[p[2]] ELSE w[p[1]] > w[p[2]] END)), qu AS (SELECT id, [[1, 2], [2, 3], [1, 3]][CAST({_d('id', 83)} % 3 + 1 AS INT)] AS q FROM ii) SELECT qu.id, bool_and(w[q[1]] < w[q[2]]) AS follows FROM qu LEFT JOIN ok USING (id) GROUP BY 1",
        "k02_boxes": "WITH b AS (SELECT " + _C + " AS id, " + ", ".join(f"CAST({_d('c_custkey', 85, 2 * k)} % 4 AS INT) AS {v}0, CAST({_d('c_custkey', 85, 2 * k)} % 4 + 1 + {_d('c_custkey', 85, 2 * k + 1)} % 3 AS INT) AS {v}1" for k, v in enumerate(("ax", "ay", "bx", "by"))) + " FROM customer), r AS (SELECT *, least(ax1, bx1) - greatest(ax0, bx0) AS ox, least(ay1, by1) - greatest(ay0, by0) AS oy, ax0 >= bx0 AND ax1 <= bx1 AND ay0 >= by0 AND ay1 <= by1 AS i, bx0 >= ax0 AND bx1 <= ax1 AND by0 >= ay0 AND by1 <= ay1 AS o, ax0 = bx0 OR ax1 = bx1 OR ay0 = by0 OR ay1 = by1 AS m FROM b) SELECT id, ax0, ax1, ay0, ay1, bx0, bx1, by0, by1, CASE WHEN ox < 0 OR oy < 0 THEN 'DC' WHEN ox = 0 OR oy = 0 THEN 'EC' WHEN i AND o THEN 'EQ' WHEN i AND m THEN 'TPP' WHEN i THEN 'NTPP' WHEN o AND m THEN 'TPPi' WHEN o THEN 'NTPPi' ELSE 'PO' END AS rel FROM r",
        "b12_questions": f"WITH {_QUESTIONS} SELECT * FROM qq",
        "b10_posteriors": f"WITH {_NETS}, {_QUESTIONS}, {joint} SELECT id, round(CASE WHEN sum(p) > 0 THEN coalesce(sum(p) FILTER (WHERE {bit('target')} = 1), 0) / sum(p) END, 6) AS p FROM jo JOIN qq USING (id) WHERE {bit('given')} = given_state GROUP BY id",
        "b14_bif": f"WITH {_NETS} SELECT id, var, CAST(len(pa) AS INT) AS parents, k, round(one, 9) AS p FROM nr",
        "b13_compact": f"WITH {_NETS}, w AS (SELECT id, var, max(one) FILTER (WHERE k = 0) AS a, max(one) FILTER (WHERE k = 1) AS b, max(one) FILTER (WHERE k = 2) AS c, max(one) FILTER (WHERE k = 3) AS e FROM nr WHERE len(pa) = 2 GROUP BY 1, 2) SELECT id, var, round(a, 6) AS leak, round(1 - (1 - c) / (1 - a), 6) AS s0, round(1 - (1 - b) / (1 - a), 6) AS s1 FROM w WHERE a < 1 AND abs((1 - e) - (1 - b) * (1 - c) / (1 - a)) <= 1e-9",
    }
