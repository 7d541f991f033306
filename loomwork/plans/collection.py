"""Pipeline (I) and framework (F) queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import scorers
from loomwork.operators import batches as b
from loomwork.operators import relational
from loomwork.scratch import scratch_path
from loomwork.scratch import table as t
from loomwork.sources import jsonl


def _level(c):
    return F.get_json_object(c, "$._level").cast("int")


def f03_match(s, d):
    """Task names equal without case and underscores."""
    plain = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit("")))
    a = t(s, d, "eval_item").select("task").distinct()
    c = t(s, d, "corpus_row").select(F.upper(F.replace("task", F.lit("_"), F.lit(""))).alias("name")).distinct()
    return a.join(c, plain(F.col("task")) == plain(F.col("name"))).select("task", "name")


def f04_catalog(s, d):
    gone = s.createDataFrame([("graph_pathfinding",)], "task string")
    return t(s, d, "eval_item").select("task").distinct().join(F.broadcast(gone), "task", "left_anti")


def f07_rounding(s, d):
    """A knob of 2.3 rounded at random by row: its mean stays."""
    v = s.range(10_000).select((F.floor(F.lit(2.3)) + (F.rand(3) < 0.3).cast("int")).alias("v"))
    return v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def f08_levels(s, d):
    """Knobs by level: additive, multiplied and capped ones."""
    n = s.range(6).select(F.col("id").cast("int").alias("level"))
    return n.select("level", (3 + 2 * F.col("level")).alias("n_items"), F.round(4 * F.pow(F.lit(1.5), F.col("level")), 6).alias("width"), F.least(10 + 5 * F.col("level"), F.lit(25)).alias("height"))


def f12_tokens(s, d):
    return t(s, d, "corpus_row").select("row_id", b.words(F.col("prompt")).cast("long").alias("n")).distinct()


def f15_validate(s, d):
    p = t(s, d, "eval_item")
    return p.agg(F.bool_and(F.length(F.trim("prompt")) > 0).alias("prompts"), F.bool_and(F.col("answer").isNotNull()).alias("answers"), (F.count("*") == F.countDistinct("item_id")).alias("ids"), F.bool_and(scorers.exact(F.col("answer"), F.col("answer")) == 1).alias("own"))


def f18_round_robin(s, d):
    """Batches of four over the tasks in turn."""
    tasks = [r["task"] for r in t(s, d, "eval_item").select("task").distinct().orderBy("task").collect()]
    arr = F.array(*[F.lit(x) for x in tasks])
    return s.range(40).select("id", F.element_at(arr, (F.pmod(F.floor(F.col("id") / 4), F.lit(len(tasks))) + 1).cast("int")).alias("task"))


def f19_dispatch(s, d):
    """Scores by task: each task's scorer is one branch of an expression."""
    e = t(s, d, "eval_item")
    a = F.concat(F.lit(" "), F.col("answer"))
    score = F.when(F.col("task") == "set_intersection", scorers.count(a, F.col("answer"))).when(F.col("task") == "table_qa", scorers.scalar(a, F.col("answer"))).otherwise(scorers.exact(a, F.col("answer")))
    return e.groupBy("task").agg(F.round(F.avg(score), 6).alias("score"), F.count("*").alias("n"))


def i01_jobs(s, d):
    tasks = t(s, d, "eval_item").select("task").distinct()
    n = tasks.join(F.broadcast(tasks.agg(F.count("*").alias("k"))))
    return n.select("task", F.explode(F.sequence(F.lit(0), (F.ceil(1000 / (16 * F.col("k"))) - 1).cast("int"))).alias("idx"))


def i03_levels(s, d):
    caps = s.createDataFrame([("table_qa", 1), ("navigation", 2)], "task string, cap int")
    lv = s.range(3).select(F.col("id").cast("int").alias("level"))
    tasks = t(s, d, "eval_item").select("task").distinct().join(F.broadcast(caps), "task", "left")
    return tasks.join(F.broadcast(lv), F.col("level") <= F.coalesce("cap", F.lit(2))).select("task", "level")


def i04_jsonl_sink(s, d):
    """Records written as JSON lines and read again: equal rows."""
    path = scratch_path(s, "jsonl")
    rows = t(s, d, "problem_collected").select("row_id", "prompt", "answer", "metadata", "task", "cot")
    rows.write.json(path)
    back = s.read.schema(rows.schema).json(path)
    return back.agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"), F.sum(F.length("metadata")).alias("chars"))


def i05_blocklist(s, d):
    blocked = s.createDataFrame([("TABLE_QA",), ("Navigation",)], "name string")
    p = t(s, d, "problem_collected")
    return p.join(F.broadcast(blocked), F.lower("task") == F.lower("name"), "left_anti").groupBy("task").agg(F.count("*").alias("n"))


def i08_identity(s, d):
    """Key of a path and size: twenty hex digits of their hash; ``i08_version`` tells times apart too."""
    f = t(s, d, "landing").select("file_path", "size_bytes", "modified_at").distinct()
    return f.select("file_path", F.substring(F.md5(F.concat_ws("|", "file_path", F.coalesce(F.col("size_bytes").cast("string"), F.lit("-")))), 1, 20).alias("key")).distinct()


def i08_version(s, d):
    """Key of a file: twenty hex digits of the hash of path, size and time."""
    f = t(s, d, "landing").select("file_path", "size_bytes", "modified_at").distinct()
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return f.select("file_path", F.substring(F.md5(F.concat_ws("|", text(F.col("file_path")), text(F.col("size_bytes")), text(F.unix_micros(F.col("modified_at").cast("timestamp"))))), 1, 20).alias("key")).distinct()


def i09_validate(s, d):
    """Per file: lines that aren't blank, and the first that is no record."""
    lines = t(s, d, "landing").select("file_key", F.posexplode(F.split("file_body", "\n")).alias("pos", "line"))
    known = jsonl.new_records(t(s, d, "landing"), t(s, d, "manifest").filter("1 = 0")).select("file_key", F.col("line_no").alias("n")).distinct()
    full = lines.select("file_key", (F.col("pos") + 1).alias("n"), "line").filter(F.regexp_replace("line", r"[\s\x{feff}]", "") != "").select("file_key", "n").distinct()
    marked = full.join(known.withColumn("ok", F.lit(True)), ["file_key", "n"], "left")
    return marked.groupBy("file_key").agg(F.count("*").alias("lines"), F.min(F.when(F.col("ok").isNull(), F.col("n"))).alias("first_bad"))


def i10_project(s, d):
    """Level of readable metadata by the row's own field."""
    p = t(s, d, "problem_collected").filter("level IS NOT NULL")
    return p.groupBy("level").agg(F.count("*").alias("n"))


def i11_incremental(s, d):
    done = t(s, d, "manifest").select("file_key").distinct()
    return t(s, d, "landing").select("file_key").distinct().join(done, "file_key", "left_anti")


def i12_batch(s, d):
    return i11_incremental(s, d).orderBy("file_key").limit(50)


def i13_batch_id(s, d):
    k = t(s, d, "landing").select("file_key").distinct().withColumn("b", F.substring("file_key", 1, 1))
    return k.groupBy("b").agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_list("file_key")), "|")), 1, 12).alias("batch_id"))


def i14_length(s, d):
    return t(s, d, "documents").filter((F.length("text") < 20_000) & (F.trim("text") != "")).groupBy("source").agg(F.count("*").alias("n"))


def i15_shards(s, d):
    """A shuffled Parquet shard, read again."""
    path = scratch_path(s, "shard")
    t(s, d, "corpus_row").repartition(4, F.xxhash64("row_id", "prompt")).write.option("compression", "snappy").parquet(path)
    return s.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"))


def i17_stats(s, d):
    m = t(s, d, "manifest")
    last = m.groupBy("file_key").agg(F.max_by("s", F.struct("t", "s")).alias("s"))
    return last.groupBy("s").agg(F.count("*").alias("n"))


def i18_resume(s, d):
    """Files landed twice and merged by key: a second run adds nothing."""
    f = t(s, d, "landing").select("file_key", F.md5("file_body").alias("h"))
    return f.unionByName(f).dropDuplicates(["file_key", "h"]).agg(F.count("*").alias("n"))


def i19_zero_shot(s, d):
    e = t(s, d, "eval_item").withColumn("pred", F.concat(F.lit("<answer>"), F.when(F.col("item_id") % 3 == 0, F.lit("0")).otherwise(F.col("answer")), F.lit("</answer>")))
    got = F.regexp_extract("pred", "<answer>(.*)</answer>", 1)
    return e.groupBy("task").agg(F.round(F.avg(scorers.exact(got, F.col("answer"))), 6).alias("score"), F.bool_and(F.col("pred").contains("<answer>")).alias("format"))


def i20_split(s, d):
    first = F.array_position(F.array(*[F.lit(x) for x in ("test", "validation", "eval", "dev")]), F.col("split"))
    e = t(s, d, "eval_item").withColumn("o", first).filter("o > 0")
    best = e.groupBy("task").agg(F.min("o").alias("o"))
    return e.join(F.broadcast(best), ["task", "o"]).select("item_id", F.col("prompt").alias("question"))


def i21_sample(s, d):
    return b.hash_sample(t(s, d, "eval_item"), ["split"], F.concat(F.lit("0:"), F.col("item_id").cast("string")), 10).select("split", "item_id")


def i22_clean(s, d):
    e = t(s, d, "eval_item").filter("split <> 'train'")
    return e.select("item_id", F.regexp_replace("prompt", r"\.+$", "").alias("question"))


def i23_macro(s, d):
    c = t(s, d, "corpus_row").filter("n_tokens IS NOT NULL AND source IS NOT NULL AND task IS NOT NULL")
    per = c.groupBy("source", "task").agg(F.avg("n_tokens").alias("m"))
    return per.groupBy("source").agg(F.round(F.avg("m"), 4).alias("macro"))


def i24_precedence(s, d):
    c = t(s, d, "corpus_row").select("row_id", F.coalesce("n_tokens", "level", F.lit(0)).cast("long").alias("metric"))
    return c.distinct()


def i25_format(s, d):
    c = t(s, d, "corpus_row").filter("prompt IS NOT NULL AND completion IS NOT NULL")
    return c.select("row_id", F.md5(F.concat("prompt", F.when(F.col("source") == "web_text", F.lit("")).otherwise(F.lit("\n\n")), "completion")).alias("h")).distinct()


def i26_budget(s, d):
    docs = t(s, d, "documents").select("doc_id", "n_chars")
    return b.token_budget(docs, "doc_id", F.col("n_chars"), 300_000, skip=5, longest=20_000).select("doc_id", "n_chars")


def i27_char_cap(s, d):
    return t(s, d, "corpus_row").filter(F.length(F.concat("prompt", "completion")) <= 4 * 128).groupBy("source").agg(F.count("*").alias("n"))


def i28_interleave(s, d):
    c, o = t(s, d, "customer").select(F.col("c_custkey").alias("id")), t(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    return b.interleave(c, o, 0.25).groupBy("origin").agg(F.count("*").alias("n"), F.round(F.min("place"), 6).alias("first"))


def i29_concat(s, d):
    c = t(s, d, "corpus_row").select(F.col("prompt").alias("text"))
    return c.unionByName(t(s, d, "eval_item").select(F.col("prompt").alias("text"))).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def i30_version(s, d):
    n = t(s, d, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "").alias("x"))
    return n.select(F.substring(F.md5("x"), 1, 8).alias("version"))


def i32_steps(s, d):
    m = t(s, d, "mix_target")
    return m.select("source", F.greatest(F.lit(1), F.floor(F.col("total_tokens") * (1 + F.col("weight")) / (128 * 8))).cast("long").alias("steps"))


def queries() -> dict:
    own = {n: f for n, f in globals().items() if n[:1] in "fi" and n[1:3].isdigit()}
    own["f09_token_gate"] = lambda s, d: b.token_gate(t(s, d, "documents").filter("text IS NOT NULL"), "text", 200).groupBy("source").agg(F.count("*").alias("n"))
    own["f13_balanced_batch"] = lambda s, d: b.balanced_batch(t(s, d, "events").select("event_id", "user_id", "event_type"), ["event_id"], "user_id", "event_type", 8, 32)
    own["f13_distinct_batch"] = lambda s, d: b.balanced_batch(t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").withColumn("k", F.concat_ws("/", "o_orderpriority", "o_custkey")), ["o_orderkey"], "k", "o_orderpriority", 200, 900).select("o_orderkey", "k")
    own["f16_default_score"] = lambda s, d: t(s, d, "eval_item").agg(F.sum(scorers.exact(F.concat(F.col("answer"), F.lit(" ")), F.col("answer"))).alias("right"))
    own["i16_shard_count"] = lambda s, d: relational.shards(t(s, d, "documents").select("doc_id"), "doc_id", 7).groupBy("shard").agg(F.count("*").alias("n"))
    return own


def oracle_sql() -> dict[str, str]:
    piece = r"len(regexp_extract_all(coalesce({}, ''), '[^\s\p{{Z}}]+'))"
    return {
        "f03_match": "SELECT DISTINCT e.task, upper(replace(c.task, '_', '')) AS name FROM eval_item e JOIN corpus_row c ON e.task = c.task",
        "f04_catalog": "SELECT DISTINCT task FROM eval_item WHERE task <> 'graph_pathfinding'",
        "f08_levels": "SELECT CAST(i AS INT) AS level, CAST(3 + 2 * i AS INT) AS n_items, round(4 * pow(1.5, i), 6) AS width, CAST(least(10 + 5 * i, 25) AS INT) AS height FROM range(6) r(i)",
        "f09_token_gate": f"SELECT source, count(*) AS n FROM documents WHERE text IS NOT NULL AND {piece.format('text')} <= 200 GROUP BY 1",
        "f12_tokens": f"SELECT DISTINCT row_id, {piece.format('prompt')} AS n FROM corpus_row",
        "f13_balanced_batch": "WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS j FROM a WHERE k = 1) SELECT event_id, user_id, event_type FROM b WHERE j <= 8 ORDER BY event_id LIMIT 32",
        "f13_distinct_batch": "WITH o AS (SELECT *, o_orderpriority || '/' || o_custkey AS key FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o_orderkey) AS r FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS j FROM a WHERE r = 1) SELECT o_orderkey, key AS k FROM b WHERE j <= 200 ORDER BY o_orderkey LIMIT 900",
        "f15_validate": "SELECT bool_and(length(trim(prompt)) > 0) AS prompts, bool_and(answer IS NOT NULL) AS answers, count(*) = count(DISTINCT item_id) AS ids, true AS own FROM eval_item",
        "f16_default_score": "SELECT CAST(count(*) AS DOUBLE) AS \"right\" FROM eval_item",
        "f18_round_robin": "WITH t AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT task FROM eval_item)) SELECT i AS id, task FROM range(40) r(i) JOIN t ON t.k = (i // 4) % t.n",
        "f19_dispatch": "SELECT task, CAST(1.0 AS DOUBLE) AS score, count(*) AS n FROM eval_item GROUP BY 1",
        "i01_jobs": "WITH t AS (SELECT DISTINCT task FROM eval_item) SELECT task, CAST(i AS INT) AS idx FROM t, range(0, CAST(ceil(1000.0 / (16 * (SELECT count(*) FROM t))) AS BIGINT)) r(i)",
        "i03_levels": "SELECT task, CAST(i AS INT) AS level FROM (SELECT DISTINCT task FROM eval_item), range(3) r(i) WHERE i <= CASE WHEN task = 'table_qa' THEN 1 ELSE 2 END",
        "i04_jsonl_sink": "SELECT count(*) AS n, count(DISTINCT row_id) AS ids, CAST(sum(length(metadata)) AS BIGINT) AS chars FROM problem_collected",
        "i05_blocklist": "SELECT task, count(*) AS n FROM problem_collected WHERE task IS NULL OR task NOT IN ('table_qa', 'navigation') GROUP BY 1",
        "i08_version": "SELECT DISTINCT file_path, substr(md5(coalesce(file_path, '-') || '|' || coalesce(CAST(size_bytes AS VARCHAR), '-') || '|' || coalesce(CAST(epoch_us(modified_at) AS VARCHAR), '-')), 1, 20) AS key FROM landing",
        "i08_identity": "SELECT DISTINCT file_path, substr(md5(file_path || '|' || coalesce(CAST(size_bytes AS VARCHAR), '-')), 1, 20) AS key FROM landing",
        "i10_project": "SELECT level, count(*) AS n FROM problem_collected WHERE level IS NOT NULL GROUP BY 1",
        "i11_incremental": "SELECT DISTINCT file_key FROM landing WHERE file_key NOT IN (SELECT file_key FROM manifest)",
        "i12_batch": "SELECT DISTINCT file_key FROM landing WHERE file_key NOT IN (SELECT file_key FROM manifest) ORDER BY 1 LIMIT 50",
        "i13_batch_id": "SELECT substr(file_key, 1, 1) AS b, substr(md5(string_agg(file_key, '|' ORDER BY file_key)), 1, 12) AS batch_id FROM (SELECT DISTINCT file_key FROM landing) GROUP BY 1",
        "i14_length": "SELECT source, count(*) AS n FROM documents WHERE length(text) < 20000 AND trim(text, ' ') <> '' GROUP BY 1",
        "i15_shards": "SELECT count(*) AS n, count(DISTINCT row_id) AS ids FROM corpus_row",
        "i16_shard_count": "SELECT CAST(s AS INT) AS shard, count(*) AS n FROM (SELECT ntile(7) OVER (ORDER BY doc_id) AS s FROM documents) GROUP BY 1",
        "i17_stats": "SELECT s, count(*) AS n FROM (SELECT file_key, arg_max(s, (t, s)) AS s FROM manifest GROUP BY 1) GROUP BY 1",
        "i18_resume": "SELECT count(*) AS n FROM (SELECT DISTINCT file_key, md5(file_body) FROM landing)",
        "i19_zero_shot": "SELECT task, round(avg(CASE WHEN item_id % 3 <> 0 OR answer = '0' THEN 1.0 ELSE 0.0 END), 6) AS score, true AS format FROM eval_item GROUP BY 1",
        "i20_split": "WITH e AS (SELECT *, list_position(['test', 'validation', 'eval', 'dev'], split) AS o FROM eval_item), f AS (SELECT *, min(o) OVER (PARTITION BY task) AS m FROM e WHERE o > 0) SELECT item_id, prompt AS question FROM f WHERE o = m",
        "i21_sample": "SELECT split, item_id FROM (SELECT split, item_id, row_number() OVER (PARTITION BY split ORDER BY md5('0:' || item_id)) AS k FROM eval_item) WHERE k <= 10",
        "i22_clean": r"SELECT item_id, regexp_replace(prompt, '\.+$', '') AS question FROM eval_item WHERE split <> 'train'",
        "i23_macro": "SELECT source, round(avg(m), 4) AS macro FROM (SELECT source, task, avg(n_tokens) AS m FROM corpus_row WHERE n_tokens IS NOT NULL AND source IS NOT NULL AND task IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
        "i24_precedence": "SELECT DISTINCT row_id, CAST(coalesce(n_tokens, level, 0) AS BIGINT) AS metric FROM corpus_row",
        "i25_format": "SELECT DISTINCT row_id, md5(prompt || CASE WHEN source = 'web_text' THEN '' ELSE chr(10) || chr(10) END || completion) AS h FROM corpus_row WHERE prompt IS NOT NULL AND completion IS NOT NULL",
        "i26_budget": "WITH k AS (SELECT doc_id, n_chars FROM documents WHERE n_chars <= 20000), o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM k), c AS (SELECT *, sum(n_chars) OVER (ORDER BY doc_id) AS s FROM o WHERE n > 5) SELECT doc_id, n_chars FROM c WHERE s - n_chars < 300000",
        "i27_char_cap": "SELECT source, count(*) AS n FROM corpus_row WHERE length(prompt || completion) <= 512 GROUP BY 1",
        "i28_interleave": "WITH o AS (SELECT o_orderkey AS id FROM orders WHERE CAST('0x' || substr(md5('42' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 < 0.25), u AS (SELECT 'main' AS origin, c_custkey AS id FROM customer UNION ALL SELECT 'side', id FROM o) SELECT origin, count(*) AS n, round(min(CAST('0x' || substr(md5('42' || origin || id), 1, 8) AS BIGINT) / 4294967296.0), 6) AS first FROM u GROUP BY 1",
        "i29_concat": "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT prompt AS text FROM corpus_row UNION ALL SELECT prompt FROM eval_item)",
        "i30_version": "SELECT substr(md5(string_agg(n_name, '' ORDER BY n_nationkey)), 1, 8) AS version FROM nation",
        "i32_steps": "SELECT source, CAST(greatest(1, floor(total_tokens * (1 + weight) / 1024)) AS BIGINT) AS steps FROM mix_target",
    }
