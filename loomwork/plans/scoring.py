"""Scorers (Z) over pairs of answer and reference made from the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import scorers as z
from loomwork.scratch import table as t


def _names(s: SparkSession, d: str) -> DataFrame:
    """Answers that are right, spaced, cut or those of the next nation."""
    n = t(s, d, "nation").select("n_nationkey", "n_name")
    after = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("next_name"))
    kind = F.col("n_nationkey") % 4
    answer = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).when(kind == 2, F.substring("n_name", 1, 3)).otherwise(F.col("next_name"))
    return n.join(after, "n_nationkey").select("n_nationkey", answer.alias("a"), F.col("n_name").alias("r"))


_NAMES = "WITH p AS (SELECT n.n_nationkey, CASE n.n_nationkey % 4 WHEN 0 THEN n.n_name WHEN 1 THEN '  ' || lower(n.n_name) || ' ' WHEN 2 THEN substr(n.n_name, 1, 3) ELSE m.n_name END AS a, n.n_name AS r FROM nation n JOIN nation m ON m.n_nationkey = n.n_nationkey + 1) "


def _numbers(s, d):
    p = t(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("decimal(12,2)").cast("string").alias("r"))
    kind = F.col("s_suppkey") % 3
    return p.withColumn("a", F.when(kind == 0, F.col("r")).when(kind == 1, F.concat(F.lit("x = "), F.col("r"), F.lit("."))).otherwise(F.lit("none")))


_NUMBERS = "WITH p AS (SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS r FROM supplier), q AS (SELECT *, s_suppkey % 3 AS k FROM p) "


def _sets(s, d):
    """Line numbers of neighbouring orders as answer and reference."""
    a = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("r"))
    return a.join(a.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("r").alias("a")), "l_orderkey")


_SETS = "WITH x AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS r FROM lineitem GROUP BY 1), p AS (SELECT x.l_orderkey, y.r AS a, x.r AS r FROM x JOIN x y ON y.l_orderkey = x.l_orderkey + 1) "


def _pairs(s, d):
    n = t(s, d, "nation").select("n_nationkey", F.concat(F.lit("it ends at ("), F.col("n_regionkey"), F.lit(", -"), F.col("n_nationkey"), F.lit(")")).alias("a"))
    return n.withColumn("r", F.concat(F.lit("("), F.col("n_nationkey") % 5, F.lit(",-"), F.col("n_nationkey"), F.lit(")")))


def z05(s, d):
    return _sets(s, d).select("l_orderkey", F.round(z.jaccard(F.col("a"), F.col("r")), 6).alias("score"))


def z03_table(s, d):
    """Cells of CSV lines: numbers within 0.01, other text alike."""
    p = t(s, d, "part").select("p_partkey", F.concat_ws(",", F.col("p_name"), F.col("p_size").cast("string"), F.format_string("%.2f", F.col("p_retailprice"))).alias("r"))
    a = F.split(F.concat_ws(",", F.element_at(F.split("r", ","), 1), F.concat(F.element_at(F.split("r", ","), 2), F.when(F.col("p_partkey") % 2 == 0, ".001").otherwise(".5")), F.element_at(F.split("r", ","), 3)), ",")
    same = F.zip_with(a, F.split("r", ","), lambda x, y: F.coalesce(F.abs(x.try_cast("double") - y.try_cast("double")) <= 0.01, x == y))
    return p.select("p_partkey", F.when(F.forall(same, lambda x: x), 1.0).otherwise(0.0).alias("score"))


def z04_conversion(s, d):
    """JSON texts that differ in spaces and order only are equal."""
    n = t(s, d, "nation")
    a = F.concat(F.lit('{ "k": '), F.col("n_nationkey"), F.lit(', "name": "'), F.col("n_name"), F.lit('" }'))
    b = F.concat(F.lit('{"name":"'), F.col("n_name"), F.lit('","k":'), F.col("n_nationkey") - F.col("n_nationkey") % 2, F.lit("}"))
    form = lambda c: F.to_json(F.from_json(c, "k INT, name STRING"))
    return n.select("n_nationkey", F.when(form(a) == form(b), 1.0).otherwise(z.levenshtein_ratio(a, b)).alias("v")).select("n_nationkey", F.round("v", 6).alias("score"))


def z07_path(s, d):
    n = t(s, d, "nation")
    return n.select("n_nationkey", F.round(z.path(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey") + 2, F.lit(2)), 6).alias("score"))


def z12_edges(s, d):
    """F1 of the pairs (order, line number) against those of the next order, per order."""
    p = _sets(s, d)
    hits = F.size(F.array_intersect("a", "r"))
    return p.select("l_orderkey", F.round(z.f1(hits, F.size("a"), F.size("r")), 6).alias("score"))


def z14_js(s, d):
    """Flags of each line number against those of all rows."""
    flags = [F.count_if(F.col("l_returnflag") == x) / F.count("*") for x in ("A", "N", "R")]
    li = t(s, d, "lineitem")
    one = li.groupBy("l_linenumber").agg(F.array(*flags).alias("p"))
    every = li.agg(F.array(*flags).alias("q"))
    return one.join(F.broadcast(every)).select("l_linenumber", F.round(z.js_reward(F.col("p"), F.col("q")), 6).alias("score"))


def z18_induction(s, d):
    g = t(s, d, "part").groupBy("p_type").agg((F.count_if(F.col("p_size") >= 1) / F.count("*")).alias("pos"), (F.count_if(F.col("p_size") > 25) / F.count("*")).alias("neg"))
    return g.select("p_type", F.round(z.induction(F.col("pos"), F.col("neg"), F.lit(0.8)), 6).alias("score"))


def z20_span(s, d):
    p = _names(s, d)
    return p.select("n_nationkey", F.round(z.marked_span(F.concat(F.lit("the "), F.col("r")), F.col("r"), F.lit(False)), 6).alias("score"))


def z23_equation(s, d):
    p = _numbers(s, d)
    r = F.when(F.col("s_suppkey") % 5 == 0, "inconsistent").otherwise(F.col("r"))
    a = F.when(F.col("s_suppkey") % 10 == 0, " Inconsistent").otherwise(F.col("a"))
    return p.select("s_suppkey", F.round(z.equation(a, r), 6).alias("score"))


def z25_tag(s, d):
    n = t(s, d, "nation")
    r = F.concat(F.lit("x"), F.col("n_regionkey").cast("string"))
    a = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("the answer is "), r)).otherwise(F.concat(r, F.lit(" or x9")))
    return n.select("n_nationkey", z.tag(a, r).alias("score"))


def z33_program(s, d):
    """Share of equal results per segment."""
    c = t(s, d, "customer")
    return c.groupBy("c_mktsegment").agg(F.round(F.avg(z.exact(F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 25).cast("string"))), 6).alias("score"))


def z29_bindings(s, d):
    """Maps compared without blanks."""
    n = t(s, d, "nation")
    a = F.transform_values(F.create_map(F.lit("x"), F.concat(F.lit("f( "), F.col("n_name"), F.lit(" )"))), lambda k, v: F.replace(v, F.lit(" "), F.lit("")))
    b = F.create_map(F.lit("x"), F.concat(F.lit("f("), F.col("n_name"), F.lit(")")))
    return n.select("n_nationkey", F.when(F.to_json(a) == F.to_json(b), 1.0).otherwise(0.0).alias("score"))


def z30_list(s, d):
    """Literal lists read as JSON; brackets of other depth are no answer."""
    p = _sets(s, d)
    read = lambda c: F.from_json(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]")), "array<int>")
    return p.select("l_orderkey", F.when(read(F.col("a")) == read(F.col("r")), 1.0).otherwise(0.0).alias("score"))


def queries() -> dict:
    pair = lambda make, key, f: lambda s, d: make(s, d).select(key, F.round(f(F.col("a"), F.col("r")), 6).alias("score"))
    return {
        "z01_exact": pair(_names, "n_nationkey", z.exact),
        "z02_scalar": pair(_numbers, "s_suppkey", z.scalar),
        "z03_table": z03_table,
        "z04_conversion": z04_conversion,
        "z05_jaccard": z05,
        "z06_count": lambda s, d: t(s, d, "nation").select("n_nationkey", F.round(z.count(F.when(F.col("n_nationkey") % 4 == 0, F.lit("many")).otherwise(F.col("n_nationkey").cast("string")), F.col("n_regionkey").cast("string")), 6).alias("score")),
        "z07_path": z07_path,
        "z09_boolean": pair(_names, "n_nationkey", z.boolean),
        "z10_position": pair(_sets, "l_orderkey", z.positionwise),
        "z12_edge_f1": z12_edges,
        "z14_js": z14_js,
        "z15_print": pair(_names, "n_nationkey", z.printed),
        "z16_levenshtein": pair(_names, "n_nationkey", z.levenshtein_ratio),
        "z18_induction": z18_induction,
        "z20_span": z20_span,
        "z23_equation": z23_equation,
        "z24_navigation": pair(_pairs, "n_nationkey", z.coordinates),
        "z25_tag": z25_tag,
        "z26_label": pair(_names, "n_nationkey", z.label),
        "z29_bindings": z29_bindings,
        "z30_list": z30_list,
        "z33_program": z33_program,
    }


def oracle_sql() -> dict[str, str]:
    near = "exp(-10 * abs(v - CAST(r AS DOUBLE)) / (abs(CAST(r AS DOUBLE)) + 1))"
    entropy = lambda a: " + ".join(f"CASE WHEN {a}{i} > 0 THEN {a}{i} * log2({a}{i} / (({'p'}{i} + q{i}) / 2)) ELSE 0 END" for i in range(3))
    flags = lambda p: ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{x}') / CAST(count(*) AS DOUBLE) AS {p}{i}" for i, x in enumerate("ANR"))
    return {
        "z01_exact": _NAMES + "SELECT n_nationkey, CASE WHEN trim(a) = trim(r) THEN 1.0 ELSE 0.0 END AS score FROM p",
        "z02_scalar": _NUMBERS + "SELECT s_suppkey, CAST(CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.0 END AS DOUBLE) AS score FROM q",
        "z03_table": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS score FROM part",
        "z04_conversion": "WITH x AS (SELECT n_nationkey, '{ \"k\": ' || n_nationkey || ', \"name\": \"' || n_name || '\" }' AS a, '{\"name\":\"' || n_name || '\",\"k\":' || (n_nationkey - n_nationkey % 2) || '}' AS b FROM nation) SELECT n_nationkey, round(CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END, 6) AS score FROM x",
        "z05_jaccard": _SETS + "SELECT l_orderkey, round(len(list_intersect(a, r)) / CAST(len(list_distinct(list_concat(a, r))) AS DOUBLE), 6) AS score FROM p",
        "z06_count": "SELECT n_nationkey, round(CASE WHEN n_nationkey % 4 = 0 THEN 0.0 ELSE 1.0 / (1 + abs(n_nationkey - n_regionkey)) END, 6) AS score FROM nation",
        "z07_path": "SELECT n_nationkey, round(CASE WHEN n_nationkey % 3 <> 0 THEN least(1.0, 2.0 / (n_regionkey + 2)) ELSE 0.0 END, 6) AS score FROM nation",
        "z09_boolean": _NAMES + "SELECT n_nationkey, CASE WHEN lower(trim(a)) = lower(trim(r)) THEN 1.0 ELSE 0.0 END AS score FROM p",
        "z10_position": _SETS + "SELECT l_orderkey, round(CASE WHEN len(a) <> len(r) THEN 0.0 ELSE len(list_filter(list_zip(a, r), lambda x: x[1] = x[2])) / CAST(len(r) AS DOUBLE) END, 6) AS score FROM p",
        "z12_edge_f1": _SETS + "SELECT l_orderkey, round(2.0 * len(list_intersect(a, r)) / (len(a) + len(r)), 6) AS score FROM p",
        "z14_js": f"WITH o AS (SELECT l_linenumber, {flags('p')} FROM lineitem GROUP BY 1), e AS (SELECT {flags('q')} FROM lineitem) SELECT l_linenumber, round(pow(1 - (({entropy('p')}) + ({entropy('q')})) / 2 / ln(2), 128), 6) AS score FROM o, e",
        "z15_print": _NAMES + r"SELECT n_nationkey, round(1 / (1 + levenshtein(trim(regexp_replace(a, '\s+', ' ', 'g')), r) / (sqrt(length(r)) + 1)), 6) AS score FROM p",
        "z16_levenshtein": _NAMES + "SELECT n_nationkey, round(1 - levenshtein(a, r) / CAST(greatest(length(a), length(r)) AS DOUBLE), 6) AS score FROM p",
        "z18_induction": "WITH g AS (SELECT p_type, count(*) FILTER (WHERE p_size >= 1) / CAST(count(*) AS DOUBLE) AS pos, count(*) FILTER (WHERE p_size > 25) / CAST(count(*) AS DOUBLE) AS neg FROM part GROUP BY 1) SELECT p_type, round(CASE WHEN pos * neg = 1 THEN 0.9 ELSE 0.49 * pos * neg END, 6) AS score FROM g",
        "z20_span": _NAMES + "SELECT n_nationkey, round(0.9 + 0.1 * length(r) / CAST(length(r) + 4 AS DOUBLE), 6) AS score FROM p",
        "z23_equation": _NUMBERS + "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 10 = 0 THEN 1.0 WHEN s_suppkey % 5 = 0 THEN 0.0 WHEN k = 0 THEN 1.0 WHEN k = 1 THEN 0.75 ELSE 0.0 END AS DOUBLE) AS score FROM q",
        "z24_navigation": "SELECT n_nationkey, CASE WHEN n_regionkey = n_nationkey % 5 THEN 1.0 ELSE 0.0 END AS score FROM nation",
        "z25_tag": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS score FROM nation",
        "z26_label": _NAMES + "SELECT n_nationkey, CASE WHEN lower(trim(a)) = lower(r) OR string_split(lower(trim(a)), ' ')[-1] = string_split(lower(r), ' ')[-1] THEN 1.0 ELSE 0.0 END AS score FROM p",
        "z29_bindings": "SELECT n_nationkey, CASE WHEN position(' ' IN n_name) = 0 THEN 1.0 ELSE 0.0 END AS score FROM nation",
        "z30_list": _SETS + "SELECT l_orderkey, CASE WHEN a = r THEN 1.0 ELSE 0.0 END AS score FROM p",
        "z33_program": "SELECT c_mktsegment, round(avg(CASE WHEN c_nationkey = c_custkey % 25 THEN 1.0 ELSE 0.0 END), 6) AS score FROM customer GROUP BY 1",
    }
