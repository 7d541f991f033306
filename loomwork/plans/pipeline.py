"""Queries of the core's data-pipeline operators: p2 and p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.operators import schema_drift
from loomwork.scratch import scratch_path, table
from loomwork.sources import compaction, jsonl


def collect_landing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """New records of the landing files, consolidated; the records and a row per file written."""
    staged, out = scratch_path(spark, "landing-parts"), scratch_path(spark, "landing-large")
    jsonl.new_records(table(spark, sf_dir, "landing"), table(spark, sf_dir, "manifest")).write.parquet(staged)
    copied = compaction.consolidate(spark, staged, out)
    return spark.read.schema(jsonl.RECORDS).option("pathGlobFilter", "*.parquet").parquet(out), copied


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect_landing(spark, sf_dir)[0].select("file_key", "line_no")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect_landing(spark, sf_dir)[0].select("file_key", "line_no", "answer", "metadata")


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect_landing(spark, sf_dir)[1].select("sources", "blocks", "n_rows", "size")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(table(spark, sf_dir, "raw_record")).select("file_id", "old_field", "new_field").distinct()


def p6_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(table(spark, sf_dir, "raw_record"))


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.unify(table(spark, sf_dir, "raw_record"))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_records": p2_records, "p2_files": p2_files, "p6_found": p6_found, "p6_changes": p6_changes, "p6_table": p6_table}


_P2 = r"""
WITH f AS (
  SELECT file_key, min(file_body) AS b FROM landing
  WHERE file_body IS NOT NULL AND file_key NOT IN (SELECT file_key FROM manifest WHERE s = 'done' AND file_key IS NOT NULL) GROUP BY 1),
l AS (
  SELECT file_key, CAST(i AS INT) AS line_no, trim(x[i], ' ' || chr(9) || chr(10) || chr(13)) AS line
  FROM (SELECT file_key, string_split(CASE WHEN b[1] = chr(65279) THEN b[2:] ELSE b END, chr(10)) AS x FROM f), unnest(range(1, len(x) + 1)) AS r(i))
SELECT file_key, line_no FROM l WHERE json_valid(line) AND line[1] = '{'
"""

_P6 = r"""
WITH rec AS (
  SELECT DISTINCT stream, file_no, file_id, record_json AS j FROM raw_record WHERE json_valid(record_json) AND json_type(record_json) = 'OBJECT'),
top AS (SELECT file_id, e.key AS field, e.type AS ty, e.value AS v FROM rec, json_each(rec.j) AS e),
box AS (
  SELECT file_id, CASE WHEN ty = 'OBJECT' THEN v WHEN ty = 'VARCHAR' AND json_valid(v ->> '$') AND json_type(v ->> '$') = 'OBJECT' THEN CAST(v ->> '$' AS JSON) END AS o FROM top),
inn AS (
  SELECT file_id, 'metadata.' || i.key AS field, i.type AS ty FROM box, json_each(box.o) AS i
  WHERE o IS NOT NULL AND len(list_filter(json_keys(o), lambda k: starts_with(k, '_'))) > 0),
fields AS (
  SELECT DISTINCT file_id, field, starts_with(field, 'metadata.') AS inside,
    CASE WHEN ty IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN ty = 'DOUBLE' THEN 'decimal' WHEN ty = 'VARCHAR' THEN 'string' ELSE lower(ty) END AS kind
  FROM (SELECT file_id, field, ty FROM top UNION ALL SELECT file_id, field, ty FROM inn) WHERE ty <> 'NULL'),
files AS (
  SELECT file_id, lag(file_id) OVER (PARTITION BY stream ORDER BY file_no, file_id) AS prev FROM (SELECT DISTINCT stream, file_no, file_id FROM raw_record)),
gone AS (SELECT f.file_id, a.field, a.kind, a.inside FROM files f JOIN fields a ON a.file_id = f.prev WHERE NOT EXISTS (SELECT 1 FROM fields b WHERE b.file_id = f.file_id AND b.field = a.field)),
come AS (SELECT f.file_id, b.field, b.kind, b.inside FROM files f JOIN fields b ON b.file_id = f.file_id WHERE f.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fields a WHERE a.file_id = f.prev AND a.field = b.field)),
one AS (
  SELECT file_id, kind, inside, max(g) AS g, max(c) AS c FROM (
    SELECT file_id, kind, inside, field AS g, NULL AS c, 1 AS ng, 0 AS nc FROM gone UNION ALL SELECT file_id, kind, inside, NULL, field, 0, 1 FROM come)
  GROUP BY 1, 2, 3 HAVING sum(ng) = 1 AND sum(nc) = 1)
SELECT f.file_id, a.field AS old_field, b.field AS new_field FROM files f JOIN fields a ON a.file_id = f.prev JOIN fields b ON b.file_id = f.file_id AND a.field = b.field AND a.kind <> b.kind
UNION ALL SELECT file_id, g, c FROM one
UNION ALL SELECT file_id, field, '' FROM gone WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.file_id = gone.file_id AND one.kind = gone.kind AND one.inside = gone.inside)
UNION ALL SELECT file_id, '', field FROM come WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.file_id = come.file_id AND one.kind = come.kind AND one.inside = come.inside)
"""


def oracle_sql() -> dict[str, str]:
    records = _P2.replace("SELECT file_key, line_no FROM l", "SELECT file_key, line_no, line ->> '$.answer' AS answer, line ->> '$.metadata' AS metadata FROM l")
    return {"p2_found": _P2, "p2_records": records, "p6_found": _P6}
