"""Further operators of the surveyed families: generators, traces, checks and the rest of the scorers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import automata, exact, grammar
from loomwork.functions import scorers as z
from loomwork.operators import calculi
from loomwork.plans.graphs import _dag, _nation_edges
from loomwork.plans.language import mapped
from loomwork.scratch import table as t


def _hash(*cols):
    """A number in [0, 1) that depends on the row only."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("double") / 2**32


# framework
def f05_row(s: SparkSession, d: str) -> DataFrame:
    """Records of the old and the new field name in one row shape."""
    n = t(s, d, "nation")
    raw = n.select("n_nationkey", F.concat(F.lit('{"'), F.when(F.col("n_nationkey") % 2 == 0, "metadata").otherwise("data"), F.lit('": "m'), F.col("n_nationkey"), F.lit('", "answer": "'), F.col("n_name"), F.lit('"}')).alias("j"))
    r = raw.select("n_nationkey", F.from_json("j", "metadata STRING, data STRING, answer STRING").alias("r"))
    return r.select("n_nationkey", F.coalesce("r.metadata", "r.data").alias("metadata"), F.col("r.answer").alias("answer"))


def f06_serialise(s, d):
    """Nested values as JSON text and back; pickled ones are refused, never opened."""
    p = t(s, d, "problem_collected").select("row_id", "metadata")
    kind = F.when(F.col("metadata").startswith("b64:"), "refused").when(F.col("metadata").isNull(), "missing").otherwise("text")
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def f09_generate(s, d):
    """Attempts of a generator until one fits the token gate; the last one where none does."""
    tries = t(s, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    made = tries.withColumn("tokens", (_hash("n_nationkey", "k") * 40).cast("int"))
    best = made.groupBy("n_nationkey").agg(F.coalesce(F.min(F.when(F.col("tokens") <= 10, F.col("k"))), F.max("k")).alias("k"))
    return best.select("n_nationkey", "k")


def f14_keys(s, d):
    """The balancing key is the answer; its largest share."""
    p = t(s, d, "eval_item").groupBy("answer").agg(F.count("*").alias("n"))
    return p.agg(F.max("n").alias("most"), F.count("*").alias("keys"))


# pipeline
def i02_claims(s, d):
    """Jobs without a finished file or a fresh lock."""
    jobs = t(s, d, "manifest").select("file_key", "s", "t")
    last = jobs.agg(F.max("t").alias("now"))
    busy = jobs.join(F.broadcast(last)).filter((F.col("s") == "done") | (F.col("now") - F.col("t") < 900)).select("file_key").distinct()
    return jobs.select("file_key").distinct().join(busy, "file_key", "left_anti")


# calculi and tracking
def k08_instances(s, d):
    """Chains of three intervals whose end relation follows: pairs of relations with a single composition."""
    c = calculi.composition(s, 3).groupBy("r1", "r2").agg(F.count("*").alias("n"), F.min("r3").alias("r3"))
    return c.filter("n = 1").select("r1", "r2", "r3")


def t02_worlds(s, d):
    """A walk on a grid: a step that would leave it is not taken."""
    e = t(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.pmod("event_id", F.lit(3)) - 1).cast("int").alias("dx")))).alias("steps"))
    fold = F.aggregate("steps", F.lit(4), lambda x, st: F.when((x + st["dx"]).between(0, 9), x + st["dx"]).otherwise(x))
    return e.select("user_id", fold.alias("x"))


def t06_distance(s, d):
    p = t(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).alias("x"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("y"))
    return p.select("n_nationkey", F.concat(F.lit("("), "x", F.lit(", "), "y", F.lit(")")).alias("final"), (F.abs(F.col("x") - 2) + F.abs(F.col("y") - 2)).alias("distance"))


def t14_mentions(s, d):
    """Sentences about users: the name at first, a pronoun where the sentence before was about the same one."""
    e = t(s, d, "events").withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("day").orderBy("event_id")
    m = e.select("event_id", F.when(F.lag("user_id").over(w) == F.col("user_id"), F.lit("they")).otherwise(F.concat(F.lit("user "), F.col("user_id"))).alias("np"))
    return m


# constraints
def c12_trace(s, d):
    """What an order holds after its last line, and the number of its lines; ``c12_states`` has the states between."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    li = t(s, d, "lineitem").withColumn("q", F.sum("l_quantity").over(w).cast("long"))
    return li.groupBy("l_orderkey").agg(F.max("q").alias("held"), F.count("*").alias("steps"))


def c12_states(s, d):
    """State after each line of an order, as number and as text."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    li = t(s, d, "lineitem").select("l_orderkey", F.count("*").over(w).alias("step"), F.sum("l_quantity").over(w).cast("long").alias("held"))
    return li.withColumn("state", F.concat(F.lit("after line "), F.col("step").cast("string"), F.lit(": "), F.coalesce(F.col("held").cast("string"), F.lit("nothing")), F.lit(" held")))


# grammars
# arithmetic and rewriting
def m05_trace(s, d):
    """Solutions of x + y = a, x - y = b with the steps in words."""
    n = t(s, d, "nation").select("n_nationkey", "n_regionkey")
    return n.select("n_nationkey", F.concat(F.lit("2x = "), F.col("n_nationkey") + F.col("n_regionkey"), F.lit("; x = "), F.format_string("%.1f", (F.col("n_nationkey") + F.col("n_regionkey")) / 2)).alias("steps"))


def lg03_bloat(s, d):
    """Of three kinds of clauses only a tenth by hash is kept."""
    n = t(s, d, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("rule"))
    return n.filter(~F.col("rule").isin(0, 1, 2) | (F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 1) == "0")).groupBy("rule").agg(F.count("*").alias("n"))


def y07_fold_constants(s, d):
    """Constant parts of expressions folded."""
    e = t(s, d, "nation").select("n_nationkey", F.concat(F.lit("(2 * 3 + "), F.col("n_nationkey"), F.lit(") - 4")).alias("expr"))
    return mapped(e, "expr", "folded", "string", lambda x: exact.as_decimal(exact.evaluate(x))).select("n_nationkey", "folded")


# inference
# scorers
def z08_list(s, d):
    n = t(s, d, "nation")
    a = F.concat(F.lit("["), F.col("n_nationkey"), F.lit(", "), F.col("n_regionkey"), F.lit("]"))
    b = F.concat(F.lit("["), F.col("n_nationkey"), F.lit(","), F.col("n_nationkey") % 5, F.lit("]"))
    read = lambda c: F.from_json(c, "array<int>")
    return n.select("n_nationkey", F.when(read(a) == read(b), 1.0).otherwise(0.0).alias("score"))


def queries() -> dict:
    own = {n: f for n, f in globals().items() if n[:1] in "fiktclxmybzg" and n[1:3].isdigit() and f.__module__ == __name__}
    return own | {"lg03_bloat": lg03_bloat}


def oracle_sql() -> dict[str, str]:
    h = lambda *c: f"CAST('0x' || substr(md5({' || chr(58) || '.join(c)}), 1, 8) AS BIGINT) / 4294967296.0"
    return {
        "f05_row": "SELECT n_nationkey, 'm' || n_nationkey AS metadata, n_name AS answer FROM nation",
        "f06_serialise": "SELECT CASE WHEN starts_with(metadata, 'b64:') THEN 'refused' WHEN metadata IS NULL THEN 'missing' ELSE 'text' END AS kind, count(*) AS n FROM problem_collected GROUP BY 1",
        "f09_generate": f"WITH m AS (SELECT n_nationkey, CAST(i AS INT) AS k, CAST(floor({h('n_nationkey', 'i')} * 40) AS INT) AS tokens FROM nation, range(10) r(i)) SELECT n_nationkey, coalesce(min(k) FILTER (WHERE tokens <= 10), max(k)) AS k FROM m GROUP BY 1",
        "f14_keys": "SELECT max(n) AS most, count(*) AS keys FROM (SELECT count(*) AS n FROM eval_item GROUP BY answer)",
        "i02_claims": "SELECT DISTINCT file_key FROM manifest WHERE file_key NOT IN (SELECT file_key FROM manifest WHERE s = 'done' OR (SELECT max(t) FROM manifest) - t < 900)",
        "t02_worlds": "WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id % 3 - 1 AS dx FROM events), w AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(4 AS BIGINT) AS x FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT w.user_id, o.k, CASE WHEN w.x + o.dx BETWEEN 0 AND 9 THEN w.x + o.dx ELSE w.x END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1) SELECT user_id, CAST(arg_max(x, k) AS INT) AS x FROM w GROUP BY 1",
        "t06_distance": "SELECT n_nationkey, '(' || n_nationkey % 5 || ', ' || n_nationkey // 5 || ')' AS final, abs(n_nationkey % 5 - 2) + abs(n_nationkey // 5 - 2) AS distance FROM nation",
        "t14_mentions": "SELECT event_id, CASE WHEN lag(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) = user_id THEN 'they' ELSE 'user ' || user_id END AS np FROM events",
        "c12_trace": "SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS held, count(*) AS steps FROM lineitem GROUP BY 1",
        "c12_states": "SELECT *, 'after line ' || step || ': ' || coalesce(CAST(held AS VARCHAR), 'nothing') || ' held' AS state FROM (SELECT l_orderkey, count(*) OVER w AS step, CAST(sum(l_quantity) OVER w AS BIGINT) AS held FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING))",
        "m05_trace": "SELECT n_nationkey, '2x = ' || (n_nationkey + n_regionkey) || '; x = ' || printf('%.1f', (n_nationkey + n_regionkey) / 2.0) AS steps FROM nation",
        "lg03_bloat": "SELECT p_partkey % 5 AS rule, count(*) AS n FROM part WHERE p_partkey % 5 > 2 OR substr(md5(CAST(p_partkey AS VARCHAR)), 1, 1) = '0' GROUP BY 1",
        "y07_fold_constants": "SELECT n_nationkey, CAST(n_nationkey + 2 AS VARCHAR) AS folded FROM nation",
        "z08_list": "SELECT n_nationkey, CASE WHEN n_regionkey = n_nationkey % 5 THEN 1.0 ELSE 0.0 END AS score FROM nation",
    }
