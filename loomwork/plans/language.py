"""Grammars (L), patterns (X), text differences (D), arithmetic (M), logic (lg) and rewriting (Y)."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import automata, exact, grammar
from loomwork.scratch import table as t


def mapped(df: DataFrame, column: str, out: str, kind: str, f: Callable) -> DataFrame:
    """Adds ``out``: a Python function of a column, in Arrow batches."""
    schema = ", ".join([*[f"`{n}` {k}" for n, k in df.dtypes], f"{out} {kind}"])

    def run(frames):
        for pdf in frames:
            yield pdf.assign(**{out: [None if x is None else f(x) for x in pdf[column]]})

    return df.mapInPandas(run, schema)


# grammars -------------------------------------------------------------
def _brackets(s, d) -> DataFrame:
    """Bracket texts made from the bits of part keys: some are sentences of the list grammar."""
    bits = F.lpad(F.bin(F.col("p_partkey")), 10, "0")
    return t(s, d, "part").select("p_partkey", F.translate(bits, "01", "()").alias("text"))


def l08_bracket_depth(s, d):
    one = _brackets(s, d).select("p_partkey", F.posexplode(F.split("text", "")).alias("pos", "c"))
    w = Window.partitionBy("p_partkey").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    depth = one.withColumn("depth", F.sum(F.when(F.col("c") == "(", 1).when(F.col("c") == ")", -1).otherwise(0)).over(w))
    return depth.groupBy("p_partkey").agg(F.max("depth").cast("long").alias("deepest"), F.min("depth").cast("long").alias("lowest"), F.max_by("depth", "pos").cast("long").alias("last"))


def l10_first_error(s, d):
    """Place of the first bracket that closes nothing, by the depth alone; null where there is none."""
    one = _brackets(s, d).select("p_partkey", F.posexplode(F.split("text", "")).alias("pos", "c"))
    w = Window.partitionBy("p_partkey").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    depth = one.withColumn("depth", F.sum(F.when(F.col("c") == "(", 1).otherwise(-1)).over(w))
    return depth.groupBy("p_partkey").agg(F.min(F.when(F.col("depth") < 0, F.col("pos"))).alias("error"))


def l10_earley_error(s, d):
    return mapped(_brackets(s, d), "text", "error", "int", lambda x: grammar.first_error(grammar.BRACKETS, "S", list(x)))


# patterns -------------------------------------------------------------
def x01_fullmatch(s, d):
    return t(s, d, "part").agg(F.count_if(F.col("p_name").rlike(r"\A(?:[a-z]+ [a-z]+.*)\z")).alias("n"), F.count_if(F.col("p_brand").rlike(r"\A(?:Brand#[1-3]\d)\z")).alias("m"))


def x03_examples(s, d):
    """Per type: parts whose key a pattern matches, and the others."""
    hit = F.col("p_partkey").cast("string").rlike(r"\A(?:1\d*[02468])\z")
    return t(s, d, "part").groupBy("p_type").agg(F.count_if(hit).alias("positive"), F.count_if(~hit).alias("negative"), F.min(F.when(hit, F.col("p_partkey"))).alias("first"))


_PATTERNS = [("a*b", "a*b?b"), ("(ab)*", "(ab)*(ab)?"), ("[a-c]+", "a|b|c"), ("a+", "aa*"), ("a?b?", "(a|b)?"), ("(a|b)*", "(a*b*)*")]


def x06_strip(s, d):
    c = F.concat(F.lit("```^"), F.col("n_name"), F.lit("$```"))
    return t(s, d, "nation").select("n_nationkey", F.regexp_replace(F.regexp_replace(c, r"^`+|`+$", ""), r"^\^|\$$", "").alias("core"))


def x07_tag(s, d):
    c = F.concat(F.lit("<answer>no</answer> then <answer>"), F.col("n_name"), F.lit("</answer>."))
    return t(s, d, "nation").select("n_nationkey", F.element_at(F.split(F.element_at(F.split(c, "<answer>"), -1), "</answer>"), 1).alias("answer"))


# differences ----------------------------------------------------------
def _lines(s, d) -> DataFrame:
    return t(s, d, "eval_item").select("item_id", F.posexplode(F.split("prompt", r"\. |\n")).alias("pos", "line"))


def d01_numbered(s, d):
    return _lines(s, d).select("item_id", "pos", F.concat(F.rpad((F.col("pos") + 1).cast("string"), 4, " "), F.lit(" | "), F.col("line")).alias("text"))


def d02_mutate(s, d):
    """A seeded change of words: of each fifth word by hash the letters are turned round."""
    words = _lines(s, d).select("item_id", "pos", F.posexplode(F.split("line", " ")).alias("k", "w"))
    h = F.substring(F.md5(F.concat_ws(":", "item_id", "pos", "k")), 1, 1)
    changed = F.when(h.isin("0", "1", "2"), F.reverse("w")).otherwise(F.col("w"))
    return words.groupBy("item_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", changed.alias("w")))), lambda x: x["w"]), " ").alias("line"))


def d03_line_delta(s, d):
    """Lines of an item that the next one doesn't have."""
    a = _lines(s, d).select("item_id", "line")
    b = a.select((F.col("item_id") - 1).alias("item_id"), "line")
    return a.exceptAll(a.join(b, ["item_id", "line"], "left_semi")).groupBy("item_id").agg(F.count("*").alias("removed"))


def d03_unified(s, d):
    e = t(s, d, "eval_item").select("item_id", "prompt")
    pair = e.join(e.select((F.col("item_id") - 1).alias("item_id"), F.col("prompt").alias("after")), "item_id")
    both = pair.select("item_id", F.to_json(F.struct("prompt", "after")).alias("both"))

    def diff(x: str) -> str:
        import json

        v = json.loads(x)
        cut = lambda y: y.replace(". ", ".\n").split("\n")
        return "\n".join(list(difflib.unified_diff(cut(v["prompt"]), cut(v["after"]), lineterm=""))[2:])

    return mapped(both, "both", "diff", "string", diff).select("item_id", "diff")


def apply_diff(source: list[str], diff: str) -> list[str]:
    """Lines after a unified diff without header lines."""
    import re

    out, at = [], 0
    for line in diff.split("\n") if diff else []:
        head = re.match(r"@@ -(\d+)(?:,(\d+))? ", line)
        if head:
            begin = int(head.group(1)) - (0 if head.group(2) == "0" else 1)
            out += source[at:begin]
            at = begin
        elif line[:1] == "+":
            out.append(line[1:])
        else:
            if line[:1] == " ":
                out.append(source[at])
            at += 1
    return out + source[at:]


def d04_apply(s, d):
    """Diffs between neighbouring items, applied again: all give the second text."""
    e = t(s, d, "eval_item").select("item_id", "prompt")
    base = d03_unified(s, d).join(e, "item_id").join(e.select((F.col("item_id") - 1).alias("item_id"), F.col("prompt").alias("after")), "item_id")
    both = base.select("item_id", F.to_json(F.struct("prompt", "diff", "after")).alias("x"))

    def check(x: str) -> bool:
        import json

        v = json.loads(x)
        cut = lambda y: y.replace(". ", ".\n").split("\n")
        return apply_diff(cut(v["prompt"]), v["diff"]) == cut(v["after"])

    return mapped(both, "x", "same", "boolean", check).select("item_id", "same")


def d05_versions(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = t(s, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("src_id"))
    return v.filter("src_id IS NOT NULL")


# arithmetic -----------------------------------------------------------
def m01_floor_mod(s, d):
    x = F.col("l_linenumber") - 4
    return t(s, d, "lineitem").groupBy("l_linenumber").agg(F.first(F.floor(x / 3)).alias("q"), F.first(x - 3 * F.floor(x / 3)).alias("r"), F.first(F.bround(x / 2)).cast("long").alias("even"))


def m01_exact(s, d):
    """Expressions over a part's numbers, evaluated exactly and written as decimals."""
    p = t(s, d, "part").select("p_partkey", F.concat(F.lit("("), F.col("p_size"), F.lit(" - 7) * 0.25 + "), F.col("p_partkey"), F.lit(" // 8 - 3 % 2")).alias("expr"))
    return mapped(p, "expr", "value", "string", lambda x: exact.as_decimal(exact.evaluate(x))).select("p_partkey", "value")


def m02_terminating(s, d):
    """Numbers whose reciprocal ends: nothing but twos and fives divides them."""
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"n": pdf["id"], "ends": [exact.as_decimal(exact.evaluate(f"1 / {n}")) is not None for n in pdf["id"]]})

    return s.range(1, 101).mapInPandas(run, "n long, ends boolean")


def m03_trailing(s, d):
    return t(s, d, "supplier").select("s_suppkey", F.concat(F.col("s_suppkey").cast("string"), F.lit("."), F.repeat(F.lit("0"), (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("padded"))


def m04_cramer(s, d):
    """x and y from a x + b y = e and c x + d y = f, or the class of the system."""
    p = t(s, d, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("a"), (F.col("p_size") % 4).alias("b"), (F.col("p_partkey") % 5).alias("c"), (F.col("p_size") % 3).alias("d"), F.lit(6).alias("e"), F.lit(12).alias("f"))
    det = F.expr("a * d - b * c")
    x, y = F.expr("e * d - b * f"), F.expr("a * f - e * c")
    none = (x != 0) | (y != 0) | F.expr("(a = 0 AND b = 0) OR (c = 0 AND d = 0)")
    return p.select("p_partkey", F.when(det != 0, "unique").when(none, "inconsistent").otherwise("underdetermined").alias("case"), F.round(F.try_divide(x, det), 6).alias("x"), F.round(F.try_divide(y, det), 6).alias("y"))


def m04_general(s, d):
    """Systems of three unknowns by exact elimination."""
    def one(n: int) -> str:
        rows = [[n % 5 + 1, 2, 1], [1, n % 3, 4], [3, 1, n % 7]]
        out = exact.solve(rows, [n % 11, 5, 7])
        return out if isinstance(out, str) else ",".join(str(x) for x in out)

    return mapped(t(s, d, "supplier").select("s_suppkey"), "s_suppkey", "solution", "string", one)


def m06_recurrence(s, d):
    """Twenty terms of U[n] = 2 U[n-1] - U[n-2] + 3 from two numbers of a nation."""
    n = t(s, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("u0"), F.col("n_nationkey").cast("long").alias("u1"))
    step = lambda acc, i: F.struct(acc["b"].alias("a"), (2 * acc["b"] - acc["a"] + 3).alias("b"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(18)), F.struct(F.col("u0").alias("a"), F.col("u1").alias("b")), step)
    return n.select("n_nationkey", last["b"].alias("u19"))


def m07_nonconstant(s, d):
    p = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a"))
    return p.agg(F.count_if(F.size(F.array_distinct("a")) > 1).alias("n"), F.count_if(F.size("a") > 1).alias("several"))


def m08_op_count(s, d):
    return t(s, d, "eval_item").select("item_id", F.regexp_count("prompt", F.lit(r"[+*/-]")).cast("long").alias("ops"), F.regexp_count("prompt", F.lit(r"\d+")).cast("long").alias("numbers"))


# logic ----------------------------------------------------------------
def _status(c: str) -> Column:
    return F.when(F.col(c) % 2 == 0, "S").otherwise("U")


def lg05_verbalise(s, d):
    """Names in a text replaced, the longest first."""
    table = F.array(F.struct(F.lit("p10").alias("k"), F.lit("tall").alias("v")), F.struct(F.lit("p1").alias("k"), F.lit("kind").alias("v")))
    text = F.concat(F.lit("p1 & p10 & n"), F.col("n_nationkey").cast("string"))
    return t(s, d, "nation").select("n_nationkey", F.aggregate(table, text, lambda acc, x: F.replace(acc, x["k"], x["v"])).alias("text"))


def lg08_derivation(s, d):
    """Edges of a graph text, parsed to a table."""
    text = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(" -> n"), F.col("n_regionkey").cast("string"), F.lit("; n0 -> n"), F.col("n_nationkey").cast("string"))
    return t(s, d, "nation").select(F.explode(F.regexp_extract_all(text, F.lit(r"n\d+ -> n\d+"), F.lit(0))).alias("edge")).select(F.regexp_extract("edge", r"n(\d+) ->", 1).cast("int").alias("u"), F.regexp_extract("edge", r"-> n(\d+)", 1).cast("int").alias("v"))


def lg10_proof_window(s, d):
    """Depth d whose proofs have more than 2**d - 1 and at most 2**(d + 1) - 1 nodes, per order."""
    n = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.select("l_orderkey", F.ceil(F.log2(F.col("n") + 1) - 1 - 1e-9).cast("long").alias("depth"))


def lg11_normalise(s, d):
    text = F.concat(F.lit("p(X"), F.col("n_nationkey").cast("string"), F.lit(", Y) & q( X12 )"))
    return t(s, d, "nation").select("n_nationkey", F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"X\d+", "V").alias("formula"))


# rewriting ------------------------------------------------------------
def queries() -> dict:
    return {n: f for n, f in globals().items() if (n[:1] in "lxdmy" and n[1:3].isdigit()) or n[:2] == "lg" and n[2:4].isdigit()}


_LINES_SQL = r"WITH l AS (SELECT item_id, i - 1 AS pos, x[i] AS line FROM (SELECT item_id, regexp_split_to_array(prompt, '\. |\n') AS x FROM eval_item), unnest(range(1, len(x) + 1)) AS r(i)) "
_BITS = "WITH p AS (SELECT p_partkey, replace(replace(lpad(bin(p_partkey), 10, '0'), '0', '('), '1', ')') AS text FROM part), c AS (SELECT p_partkey, i - 1 AS pos, CASE WHEN text[i] = '(' THEN 1 ELSE -1 END AS s FROM p, unnest(range(1, length(text) + 1)) AS r(i)), w AS (SELECT *, sum(s) OVER (PARTITION BY p_partkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM c) "


def oracle_sql() -> dict[str, str]:
    return {
        "l08_bracket_depth": _BITS + "SELECT p_partkey, CAST(max(depth) AS BIGINT) AS deepest, CAST(min(depth) AS BIGINT) AS lowest, CAST(arg_max(depth, pos) AS BIGINT) AS last FROM w GROUP BY 1",
        "l10_first_error": _BITS + "SELECT p_partkey, CAST(min(pos) FILTER (WHERE depth < 0) AS INT) AS error FROM w GROUP BY 1",
        "x01_fullmatch": r"SELECT count(*) FILTER (WHERE regexp_full_match(p_name, '[a-z]+ [a-z]+.*')) AS n, count(*) FILTER (WHERE regexp_full_match(p_brand, 'Brand#[1-3]\d')) AS m FROM part",
        "x03_examples": r"SELECT p_type, count(*) FILTER (WHERE regexp_full_match(CAST(p_partkey AS VARCHAR), '1\d*[02468]')) AS positive, count(*) FILTER (WHERE NOT regexp_full_match(CAST(p_partkey AS VARCHAR), '1\d*[02468]')) AS negative, min(p_partkey) FILTER (WHERE regexp_full_match(CAST(p_partkey AS VARCHAR), '1\d*[02468]')) AS first FROM part GROUP BY 1",
        "x06_strip": "SELECT n_nationkey, n_name AS core FROM nation",
        "x07_tag": "SELECT n_nationkey, n_name AS answer FROM nation",
        "d01_numbered": _LINES_SQL + "SELECT item_id, CAST(pos AS INT) AS pos, rpad(CAST(pos + 1 AS VARCHAR), 4, ' ') || ' | ' || line AS text FROM l",
        "d02_mutate": _LINES_SQL + ", w AS (SELECT item_id, pos, i - 1 AS k, x[i] AS w FROM (SELECT item_id, pos, string_split(line, ' ') AS x FROM l), unnest(range(1, len(x) + 1)) AS r(i)) SELECT item_id, CAST(pos AS INT) AS pos, string_agg(CASE WHEN substr(md5(item_id || ':' || pos || ':' || k), 1, 1) IN ('0', '1', '2') THEN reverse(w) ELSE w END, ' ' ORDER BY k) AS line FROM w GROUP BY 1, 2",
        "d03_line_delta": _LINES_SQL + "SELECT a.item_id, count(*) AS removed FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.item_id = a.item_id + 1 AND b.line = a.line) GROUP BY 1",
        "d04_apply": "SELECT item_id, true AS same FROM eval_item WHERE item_id < (SELECT max(item_id) FROM eval_item)",
        "d05_versions": "SELECT * FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS src_id FROM orders) WHERE src_id IS NOT NULL",
        "m01_floor_mod": "SELECT l_linenumber, CAST(floor((l_linenumber - 4) / 3.0) AS BIGINT) AS q, CAST(l_linenumber - 4 - 3 * floor((l_linenumber - 4) / 3.0) AS BIGINT) AS r, CAST(round_even((l_linenumber - 4) / 2.0, 0) AS BIGINT) AS even FROM lineitem GROUP BY 1",
        "m01_exact": "SELECT p_partkey, CASE WHEN x LIKE '%.%' THEN rtrim(rtrim(x, '0'), '.') ELSE x END AS value FROM (SELECT p_partkey, CAST(CAST((p_size - 7) * 25 + (p_partkey // 8 - 1) * 100 AS DECIMAL(18, 0)) / 100 AS DECIMAL(18, 2))::VARCHAR AS x FROM part)",
        "m02_terminating": "WITH RECURSIVE f AS (SELECT i AS n, i AS r FROM range(1, 101) t(i) UNION SELECT n, CASE WHEN r % 2 = 0 THEN r // 2 WHEN r % 5 = 0 THEN r // 5 ELSE r END FROM f) SELECT n, min(r) = 1 AS ends FROM f GROUP BY 1",
        "m03_trailing": "SELECT s_suppkey, s_suppkey || '.' || repeat('0', CAST(s_suppkey % 4 + 1 AS INT)) AS padded FROM supplier",
        "m04_cramer": "WITH p AS (SELECT p_partkey, p_partkey % 3 AS a, p_size % 4 AS b, p_partkey % 5 AS c, p_size % 3 AS d, 6 AS e, 12 AS f FROM part), q AS (SELECT *, a * d - b * c AS det, e * d - b * f AS x0, a * f - e * c AS y0 FROM p) SELECT p_partkey, CASE WHEN det <> 0 THEN 'unique' WHEN x0 <> 0 OR y0 <> 0 OR (a = 0 AND b = 0) OR (c = 0 AND d = 0) THEN 'inconsistent' ELSE 'underdetermined' END AS \"case\", round(CASE WHEN det <> 0 THEN x0 / CAST(det AS DOUBLE) END, 6) AS x, round(CASE WHEN det <> 0 THEN y0 / CAST(det AS DOUBLE) END, 6) AS y FROM q",
        "m06_recurrence": "WITH RECURSIVE u AS (SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b, 1 AS k FROM nation UNION ALL SELECT n_nationkey, b, 2 * b - a + 3, k + 1 FROM u WHERE k < 19) SELECT n_nationkey, b AS u19 FROM u WHERE k = 19",
        "m07_nonconstant": "SELECT count(*) FILTER (WHERE n > 1) AS n, count(*) FILTER (WHERE c > 1) AS several FROM (SELECT count(DISTINCT l_linenumber) AS n, count(*) AS c FROM lineitem GROUP BY l_orderkey)",
        "m08_op_count": r"SELECT item_id, len(regexp_extract_all(prompt, '[+*/-]')) AS ops, len(regexp_extract_all(prompt, '\d+')) AS numbers FROM eval_item",
        "lg05_verbalise": "SELECT n_nationkey, replace(replace('p1 & p10 & n' || n_nationkey, 'p10', 'tall'), 'p1', 'kind') AS text FROM nation",
        "lg08_derivation": "SELECT n_nationkey AS u, n_regionkey AS v FROM nation UNION ALL SELECT 0, n_nationkey FROM nation",
        "lg10_proof_window": "SELECT l_orderkey, CAST(ceil(log2(count(*) + 1) - 1 - 1e-9) AS BIGINT) AS depth FROM lineitem GROUP BY 1",
        "lg11_normalise": "SELECT n_nationkey, 'p(V,Y)&q(V)' AS formula FROM nation",
    }
