"""Questions about one table (Q) and its renderings (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import rendering as R
from loomwork.operators import relational as rel
from loomwork.scratch import table as t


def q00_sql(s: SparkSession, d: str) -> DataFrame:
    t(s, d, "customer").createOrReplaceTempView("customer_q00")
    return s.sql("SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 2) AS mean FROM customer_q00 GROUP BY c_mktsegment")


def q11_random_table(s: SparkSession, d: str) -> DataFrame:
    """A seeded random table with the columns of the question generator."""
    pick = lambda values, seed: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))
    return s.range(200).select(
        "id", pick(["north", "south", "east"], 1).alias("city"), pick(["pen", "lamp", "desk", "sofa"], 2).alias("product"),
        (F.floor(F.rand(3) * 1000) + 1).cast("int").alias("qty"), F.round(10 + F.rand(4) * 990, 2).alias("revenue"), F.round(1 + F.rand(5) * 4, 1).alias("rating"),
    )


def _row_text(s: SparkSession, d: str, f) -> DataFrame:
    p = t(s, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return p.select("p_partkey", f(["p_partkey", "p_name", "p_size"], {"p_retailprice"}).alias("line"))


def _regions(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "region")


def _document(s: SparkSession, d: str, name: str) -> DataFrame:
    """The region table as one text of a format."""
    return R.document(_regions(s, d), ["r_regionkey", "r_name"], "r_regionkey", name)


def r10_convert(s: SparkSession, d: str) -> DataFrame:
    """CSV text parsed to a table and rendered as JSON lines."""
    lines = t(s, d, "nation").select("n_nationkey", R.csv_line(["n_nationkey", "n_name", "n_regionkey"]).alias("line"))
    parsed = lines.select("n_nationkey", F.from_csv("line", "k INT, name STRING, region INT").alias("r"))
    return parsed.select("n_nationkey", F.to_json(F.struct("r.k", "r.name", "r.region")).alias("json"))


def queries() -> dict:
    li = lambda s, d: t(s, d, "lineitem")
    orders = lambda s, d: t(s, d, "orders")
    out = {"q00_sql": q00_sql}
    for how in rel.SCALARS:
        out[f"q01_scalar_{how}"] = lambda s, d, how=how: rel.scalar(li(s, d), how, "l_extendedprice")
    for q in (30, 50, 70):
        out[f"q02_quantile_count_{q}"] = lambda s, d, q=q: rel.above_quantile(li(s, d), "l_quantity", q / 100)
    out |= {
        "q03_order_limit": lambda s, d: rel.top_rows(orders(s, d), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"),
        "q04_avg_product": lambda s, d: li(s, d).agg(F.round(F.avg(F.col("l_quantity") * F.col("l_discount")), 2).alias("v")),
        "q05_group_topk_desc": lambda s, d: rel.group_top(orders(s, d), "o_orderpriority", "o_totalprice", 3, True),
        "q05_group_topk_asc": lambda s, d: rel.group_top(li(s, d), "l_returnflag", "l_quantity", 2, False),
        "q06_eq_and_above_mean": lambda s, d: rel.equal_above_mean(t(s, d, "customer"), "c_mktsegment", "BUILDING", "c_acctbal"),
        "q07_count_distinct": lambda s, d: orders(s, d).agg(F.countDistinct("o_orderpriority").alias("n")),
        "q08_eq_count": lambda s, d: orders(s, d).filter(F.col("o_orderstatus") == "F").agg(F.count("*").alias("n")),
        "q09_like_cast": lambda s, d: t(s, d, "events").filter(F.expr("cast(event_id AS STRING) LIKE '%42%' ESCAPE '!'")).agg(F.count("*").alias("n")),
        "q10_count": lambda s, d: t(s, d, "events").agg(F.count("*").alias("n")),
        "q11_random_table": q11_random_table,
        "q12_csv_answer": lambda s, d: R.document(_regions(s, d), ["r_regionkey", "r_name"], "r_regionkey", "csv_body"),
        "q13_shard": lambda s, d: rel.shards(orders(s, d).select("o_orderkey"), "o_orderkey", 3).groupBy("shard").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")),
        "q14_reconstruct": lambda s, d: rel.group_top(rel.shards(orders(s, d).select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey", 2).filter("shard = 1").unionByName(rel.shards(orders(s, d).select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey", 2).filter("shard = 2")), "o_orderpriority", "o_totalprice", 3, True),
        "r01_format_float": lambda s, d: t(s, d, "part").select("p_partkey", R.format_float(F.col("p_retailprice")).alias("v")),
        "r02_canonical_floats": lambda s, d: R.canonical_floats(t(s, d, "supplier").select("s_suppkey", "s_acctbal")),
        "r03_fixed_width": lambda s, d: _document(s, d, "text"),
        "r04_markdown": lambda s, d: _document(s, d, "markdown"),
        "r05_csv_row": lambda s, d: _row_text(s, d, lambda a, b: R.csv_line(a)),
        "r05_csv": lambda s, d: _document(s, d, "csv"),
        "r06_html": lambda s, d: _document(s, d, "html"),
        "r06_html_row": lambda s, d: _row_text(s, d, lambda a, b: R.html_line(a)),
        "r07_latex": lambda s, d: _document(s, d, "latex"),
        "r08_json": lambda s, d: _document(s, d, "json"),
        "r08_json_row": lambda s, d: _row_text(s, d, lambda a, b: F.to_json(F.struct(*a))),
        "r09_yaml": lambda s, d: _document(s, d, "yaml"),
        "r10_convert": r10_convert,
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {"q00_sql": "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY c_mktsegment"}
    for how in rel.SCALARS:
        out[f"q01_scalar_{how}"] = f"SELECT round({how}(l_extendedprice), 2) AS v FROM lineitem"
    for q in (30, 50, 70):
        out[f"q02_quantile_count_{q}"] = f"SELECT count(*) AS n FROM lineitem WHERE l_quantity > (SELECT quantile_cont(l_quantity, {q / 100}) FROM lineitem)"
    body = "string_agg(CAST(r_regionkey AS VARCHAR) || ',' || r_name, chr(10) ORDER BY r_regionkey)"
    width = "(SELECT CAST(max(length(r_name)) AS INT) FROM region)"
    out |= {
        "q03_order_limit": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3",
        "q04_avg_product": "SELECT round(avg(l_quantity * l_discount), 2) AS v FROM lineitem",
        "q05_group_topk_desc": "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1 ORDER BY v DESC, 1 LIMIT 3",
        "q05_group_topk_asc": "SELECT l_returnflag, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1 ORDER BY v, 1 LIMIT 2",
        "q06_eq_and_above_mean": "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
        "q07_count_distinct": "SELECT count(DISTINCT o_orderpriority) AS n FROM orders",
        "q08_eq_count": "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'",
        "q09_like_cast": "SELECT count(*) AS n FROM events WHERE CAST(event_id AS VARCHAR) LIKE '%42%'",
        "q10_count": "SELECT count(*) AS n FROM events",
        "q12_csv_answer": f"SELECT {body} AS text FROM region",
        "q13_shard": "SELECT CAST(s AS INT) AS shard, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, ntile(3) OVER (ORDER BY o_orderkey) AS s FROM orders) GROUP BY s",
        "q14_reconstruct": "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1 ORDER BY v DESC, 1 LIMIT 3",
        "r01_format_float": "SELECT p_partkey, CASE WHEN rtrim(printf('%.12f', p_retailprice), '0') LIKE '%.' THEN rtrim(printf('%.12f', p_retailprice), '0') || '0' ELSE rtrim(printf('%.12f', p_retailprice), '0') END AS v FROM part",
        "r02_canonical_floats": "SELECT s_suppkey, CASE WHEN rtrim(printf('%.12f', s_acctbal), '0') LIKE '%.' THEN rtrim(printf('%.12f', s_acctbal), '0') || '0' ELSE rtrim(printf('%.12f', s_acctbal), '0') END AS s_acctbal FROM supplier",
        "r03_fixed_width": f"SELECT 'r_regionkey ' || lpad('r_name', CAST(greatest(6, {width}) AS INT), ' ') || chr(10) || string_agg(lpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' ' || lpad(r_name, CAST(greatest(6, {width}) AS INT), ' '), chr(10) ORDER BY r_regionkey) AS text FROM region",
        "r04_markdown": f"SELECT '| r_regionkey | ' || rpad('r_name', CAST(greatest(6, {width}) AS INT), ' ') || ' |' || chr(10) || '|:' || repeat('-', 12) || '|:' || repeat('-', CAST(greatest(6, {width}) AS INT) + 1) || '|' || chr(10) || string_agg('| ' || rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' | ' || rpad(r_name, CAST(greatest(6, {width}) AS INT), ' ') || ' |', chr(10) ORDER BY r_regionkey) AS text FROM region",
        "r05_csv_row": "SELECT p_partkey, CAST(p_partkey AS VARCHAR) || ',' || p_name || ',' || CAST(p_size AS VARCHAR) AS line FROM part",
        "r05_csv": f"SELECT 'r_regionkey,r_name' || chr(10) || {body} AS text FROM region",
        "r06_html": "SELECT '<table><thead><tr><th>r_regionkey</th><th>r_name</th></tr></thead><tbody>' || string_agg('<tr><td>' || CAST(r_regionkey AS VARCHAR) || '</td><td>' || r_name || '</td></tr>', '' ORDER BY r_regionkey) || '</tbody></table>' AS text FROM region",
        "r06_html_row": "SELECT p_partkey, '<tr><td>' || CAST(p_partkey AS VARCHAR) || '</td><td>' || p_name || '</td><td>' || CAST(p_size AS VARCHAR) || '</td></tr>' AS line FROM part",
        "r07_latex": r"SELECT '\begin{tabular}{ll}' || chr(10) || '\toprule' || chr(10) || 'r\_regionkey & r\_name \\' || chr(10) || '\midrule' || chr(10) || string_agg(CAST(r_regionkey AS VARCHAR) || ' & ' || replace(r_name, '_', '\_') || ' \\', chr(10) ORDER BY r_regionkey) || chr(10) || '\bottomrule' || chr(10) || '\end{tabular}' AS text FROM region",
        "r08_json": "SELECT '[' || string_agg('{\"r_regionkey\":' || CAST(r_regionkey AS VARCHAR) || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS text FROM region",
        "r08_json_row": "SELECT p_partkey, '{\"p_partkey\":' || CAST(p_partkey AS VARCHAR) || ',\"p_name\":\"' || p_name || '\",\"p_size\":' || CAST(p_size AS VARCHAR) || '}' AS line FROM part",
        "r09_yaml": "SELECT string_agg('- r_regionkey: ' || CAST(r_regionkey AS VARCHAR) || chr(10) || '  r_name: ' || r_name, chr(10) ORDER BY r_regionkey) AS text FROM region",
        "r10_convert": "SELECT n_nationkey, '{\"k\":' || CAST(n_nationkey AS VARCHAR) || ',\"name\":\"' || n_name || '\",\"region\":' || CAST(n_regionkey AS VARCHAR) || '}' AS json FROM nation",
    }
    return out
