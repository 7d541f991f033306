"""What Spark offers beyond the surveyed behaviour: joins, cubes, windows, streams (prefix ext)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import tables
from loomwork.operators import joins
from loomwork.scratch import table as t
from loomwork.sources import generated
from loomwork.streaming import events as st


def ext_inner_join(s, d):
    return t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("v"))


def ext_left_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


def ext_full_join(s, d):
    a = t(s, d, "supplier").select(F.col("s_nationkey").alias("k")).groupBy("k").agg(F.count("*").alias("suppliers"))
    b = t(s, d, "customer").select(F.col("c_nationkey").alias("k")).groupBy("k").agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full").select("k", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


def ext_semi_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


def ext_anti_join(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


def ext_salted_join(s, d):
    return joins.salted_join(t(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), t(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").groupBy("s_nationkey").agg(F.count("*").alias("n"))


def ext_as_of(s, d):
    e = t(s, d, "events")
    buys = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("p_id"))
    return joins.as_of(e.select("event_id", "user_id", "ts"), buys, "user_id", "ts", "p_ts", ["p_id"]).select("event_id", "p_id")


def ext_range_join(s, d):
    """Overlapping spans of the orders of one customer segment, counted."""
    o = t(s, d, "orders").select("o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("a0"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("w"), "o_orderstatus")
    p = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), "a0", (F.col("a0") + F.col("w")).alias("a1"))
    q = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.col("a0").alias("b0"), (F.col("a0") + F.col("w")).alias("b1"))
    return joins.interval_overlap(p, q, 8).groupBy("k").agg(F.count("*").alias("n"))


def ext_cube(s, d):
    return t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


def ext_rollup(s, d):
    n = t(s, d, "nation").join(t(s, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    return n.rollup("n_regionkey", "n_name").agg(F.count("*").alias("n"))


def ext_ranks(s, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t(s, d, "customer").select("c_custkey", F.row_number().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("q"))


def ext_frames(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("next"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 4).alias("mean3"))


def ext_right_join(s, d):
    o = t(s, d, "orders").filter("o_orderstatus = 'P'")
    return o.join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_orderkey").alias("last"))


def ext_merge_join(s, d):
    """Two large sides on one key: a sort-merge join, sorted once on both sides."""
    o, li = t(s, d, "orders"), t(s, d, "lineitem")
    return li.hint("merge").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


def ext_grouping_sets(s, d):
    o = t(s, d, "orders")
    sets = [["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []]
    return o.groupingSets([[F.col(c) for c in x] for x in sets], "o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def ext_percent_ranks(s, d):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t(s, d, "part").select("p_partkey", F.rank().over(w).alias("r"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


def ext_range_frames(s, d):
    """By value, not by row: the other parts of a brand within two sizes, and the first and last of the brand."""
    w = Window.partitionBy("p_brand").orderBy("p_size")
    whole = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = F.count("*").over(w.rangeBetween(-2, 2))
    return t(s, d, "part").select("p_partkey", near.alias("near"), F.first("p_partkey").over(whole).alias("smallest"), F.last("p_partkey").over(whole).alias("largest"))


def ext_union_intersect(s, d):
    k = lambda table, c: t(s, d, table).select(F.col(c).alias("k"))
    a, b, c = k("customer", "c_nationkey"), k("supplier", "s_nationkey"), k("nation", "n_nationkey")
    named = lambda df, x: df.groupBy("k").agg(F.count("*").alias("n")).withColumn("op", F.lit(x))
    out = named(a.unionAll(b), "union all").unionByName(named(a.union(b).distinct(), "union"))
    out = out.unionByName(named(a.intersect(b), "intersect")).unionByName(named(a.intersectAll(b), "intersect all"))
    return out.unionByName(named(c.subtract(b), "except"))


def ext_date_parts(s, d):
    o = t(s, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", F.date_add("day", 30).alias("due"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("quarter"), F.datediff(F.last_day("day"), F.col("day")).alias("left"), F.add_months("day", 1).alias("next_month"), F.dayofweek("day").alias("weekday"))


def ext_maps(s, d):
    """Counts by status as a map, turned into shares."""
    per = t(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    own = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda acc, x: acc + x)
    shares = F.transform_values("m", lambda k, v: F.round(v / total, 4))
    return own.select("o_custkey", F.explode(F.map_filter(shares, lambda k, v: k != "P")).alias("status", "share"))


def ext_variant(s, d):
    """A field of JSON text through the variant type, and through a schema."""
    e = t(s, d, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"), F.from_json("props", "k int")["k"].alias("typed"), F.json_object_keys("props").alias("names")).select("event_id", "k", "typed", F.size("names").alias("n"))


def ext_approx_quantile(s, d):
    """How far the rank of the sketched median is from the middle, per status, at most one in a hundred."""
    o = t(s, d, "orders").select("o_orderstatus", "o_totalprice")
    m = o.groupBy("o_orderstatus").agg(F.approx_percentile("o_totalprice", 0.5, 1000).alias("m"))
    ranked = o.join(F.broadcast(m), "o_orderstatus").groupBy("o_orderstatus").agg(F.avg((F.col("o_totalprice") <= F.col("m")).cast("double")).alias("rank"), F.count("*").alias("n"))
    return ranked.select("o_orderstatus", "n", (F.abs(F.col("rank") - 0.5) <= F.greatest(F.lit(0.01), 1 / F.col("n"))).alias("near"))


def ext_sliding(s, d):
    """Events in windows of a day that begin every six hours."""
    e = t(s, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("window.start").cast("timestamp_ntz").alias("begin"), "event_type", "n")


def ext_udtf(s, d):
    """Words of a name as rows, by a table function in Arrow batches of its input rows."""
    return tables.words_of_names(s, t(s, d, "part").select("p_partkey", "p_name"))


def ext_custom_source(s, d):
    """A range of squares read through a source of our own, joined to the parts of that size."""
    squares = generated.squares(s, 50)
    return t(s, d, "part").join(F.broadcast(squares), F.col("p_size") == F.col("n")).groupBy("square").agg(F.count("*").alias("parts"))


def ext_pandas_udaf(s, d):
    """Mean and spread of a group by an aggregate over Arrow batches."""
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(tables.trimmed_range(F.col("l_quantity")).alias("spread")).select("l_returnflag", F.round("spread", 4).alias("spread"))


def ext_pivot(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def ext_approx(s, d):
    """Sketches within their error bounds of the exact values."""
    a = t(s, d, "orders").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.countDistinct("o_custkey").alias("n"))
    return a.select((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


def ext_percentiles(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.round(F.percentile("o_totalprice", F.lit(0.5)), 4).alias("median"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"))


def ext_set_ops(s, d):
    a, b = t(s, d, "customer").select(F.col("c_nationkey").alias("k")), t(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.exceptAll(b).groupBy("k").agg(F.count("*").alias("n"))


def ext_dates(s, d):
    o = t(s, d, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def ext_json(s, d):
    return t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def ext_sessions(s, d):
    """Sessions by gaps of more than six hours, in batch."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(s, d, "events").withColumn("new", F.when(F.col("ts") - F.lag("ts").over(w) < F.expr("INTERVAL 6 HOURS"), 0).otherwise(1))
    e = e.withColumn("sid", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "sid").agg(F.min("ts").alias("begin"), F.count("*").alias("n")).drop("sid")


def ext_vectors(s, d):
    """Squared length of each vector, by a fold over its array."""
    sq = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return t(s, d, "embeddings").select("vec_id", F.round(sq, 4).alias("norm2"))


def ext_stream_tumbling(s, d):
    return st.drain(st.tumbling_counts(st.read_events(s, d)), "complete", "stream-windows")


def ext_stream_sessions(s, d):
    return st.drain(st.sessions(st.read_events(s, d)), "complete", "stream-sessions").select("user_id", "begin", "n")


def ext_stream_state(s, d):
    rows = st.drain(st.running_state(st.read_events(s, d)), "update", "stream-state")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("n", "last_type"), "n").alias("x")).select("user_id", "x.n", "x.last_type")


def ext_stream_sliding(s, d):
    return st.drain(st.sliding_counts(st.read_events(s, d)), "complete", "stream-sliding")


def ext_stream_append(s, d):
    """Closed windows only: each is put out once, when the watermark has passed its end."""
    return st.drain(st.tumbling_counts(st.read_events(s, d)), "append", "stream-append")


def ext_stream_late(s, d):
    """Events that come later than the watermark allows are routed to rows of their own, the others counted by day."""
    return st.late_and_counted(s, d)


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("ext_")}


def oracle_sql() -> dict[str, str]:
    span = "SELECT o_orderkey AS k, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a0, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 5 + 1 AS a1 FROM orders WHERE o_orderstatus = "
    w = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    sess = f"WITH e AS (SELECT *, CASE WHEN ts - lag(ts) {w} < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS nw FROM events), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM e) SELECT user_id, min(ts) AS begin, count(*) AS n FROM g GROUP BY user_id, sid"
    return {
        "ext_inner_join": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        "ext_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
        "ext_full_join": "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS suppliers, coalesce(b.n, 0) AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k",
        "ext_semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
        "ext_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
        "ext_salted_join": "SELECT s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
        "ext_as_of": "SELECT e.event_id, max_by(p.event_id, (p.ts, p.event_id)) AS p_id FROM events e LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts GROUP BY 1",
        "ext_range_join": f"SELECT p.k, count(*) AS n FROM ({span}'P') p JOIN ({span}'F') q ON p.a0 < q.a1 AND q.a0 < p.a1 GROUP BY 1",
        "ext_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
        "ext_rollup": "SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_name)",
        "ext_ranks": "SELECT c_custkey, row_number() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER w AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)",
        "ext_frames": f"SELECT event_id, lag(event_type) {w} AS before, lead(event_type) {w} AS next, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 4) AS mean3 FROM events",
        "ext_right_join": "SELECT c_custkey, count(o_orderkey) AS n, max(o_orderkey) AS last FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        "ext_merge_join": "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
        "ext_grouping_sets": "SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) AS level, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
        "ext_percent_ranks": "SELECT p_partkey, rank() OVER w AS r, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
        "ext_range_frames": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, first_value(p_partkey) OVER w AS smallest, last_value(p_partkey) OVER w AS largest FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        "ext_union_intersect": "WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier), c AS (SELECT n_nationkey AS k FROM nation) SELECT k, count(*) AS n, 'union all' AS op FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k UNION ALL SELECT k, 1, 'union' FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT k, 1, 'intersect' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT k, count(*), 'intersect all' FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) GROUP BY k UNION ALL SELECT k, 1, 'except' FROM (SELECT * FROM c EXCEPT SELECT * FROM b)",
        "ext_date_parts": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST(last_day(o_orderdate) - CAST(o_orderdate AS DATE) AS INT) AS left, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(dayofweek(o_orderdate) + 1 AS INT) AS weekday FROM orders",
        "ext_maps": "WITH p AS (SELECT o_custkey, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, status, share FROM (SELECT o_custkey, status, round(n / sum(n) OVER (PARTITION BY o_custkey), 4) AS share FROM p) WHERE status <> 'P'",
        "ext_variant": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) AS typed, CAST(len(json_keys(props)) AS INT) AS n FROM events",
        "ext_approx_quantile": "SELECT o_orderstatus, count(*) AS n, abs(avg(CASE WHEN o_totalprice <= m THEN 1 ELSE 0 END) - 0.5) <= greatest(0.01, 1 / count(*)) AS near FROM orders JOIN (SELECT o_orderstatus AS st, quantile_disc(o_totalprice, 0.5) AS m FROM orders GROUP BY 1) ON st = o_orderstatus GROUP BY 1",
        "ext_sliding": "SELECT b AS begin, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS * i AS b, event_type FROM events, range(4) AS r(i)) GROUP BY 1, 2",
        "ext_udtf": "SELECT p_partkey, CAST(i AS INT) AS place, x[i] AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS x FROM part), unnest(range(1, len(x) + 1)) AS r(i) WHERE x[i] <> ''",
        "ext_custom_source": "SELECT CAST(p_size * p_size AS BIGINT) AS square, count(*) AS parts FROM part WHERE p_size < 50 GROUP BY 1",
        "ext_pandas_udaf": "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9) - quantile_cont(l_quantity, 0.1), 4) AS spread FROM lineitem GROUP BY 1",
        "ext_stream_sliding": "SELECT b AS begin, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS * i AS b, event_type FROM events, range(4) AS r(i)) GROUP BY 1, 2",
        "ext_stream_append": "WITH w AS (SELECT date_trunc('day', ts) AS begin, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2) SELECT * FROM w WHERE begin + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
        "ext_stream_late": "WITH e AS (SELECT *, event_id // 500 AS wave FROM events), m AS (SELECT wave, max(ts) AS top FROM e GROUP BY 1), b AS (SELECT wave, max(top) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAYS AS mark FROM m) SELECT date_trunc('day', ts) AS day, coalesce(ts < mark, false) AS late, count(*) AS n FROM e JOIN b USING (wave) GROUP BY 1, 2",
        "ext_pivot": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
        "ext_approx": "SELECT true AS near",
        "ext_percentiles": "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1",
        "ext_set_ops": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
        "ext_dates": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1",
        "ext_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
        "ext_sessions": sess,
        "ext_vectors": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm2 FROM embeddings",
        "ext_stream_tumbling": "SELECT date_trunc('day', ts) AS begin, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2",
        "ext_stream_sessions": sess,
        "ext_stream_state": "SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1",
    }
