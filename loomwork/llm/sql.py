"""SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_P1 = r"""
WITH rows AS (
  SELECT level, regexp_replace(lower(mode), '[\s\p{Z}\p{Pd}_]', '', 'g') AS m, count(*) AS n
  FROM problem_collected WHERE level IS NOT NULL AND mode IS NOT NULL GROUP BY ALL),
cats AS (
  SELECT t.level, t.mode, t.target_share, t.min_rows, t.sample_rows,
         greatest(CAST(t.min_rows AS DOUBLE), t.target_share * t.sample_rows) AS wanted,
         CAST(coalesce(r.n, 0) AS BIGINT) AS available
  FROM sample_target t LEFT JOIN rows r
    ON r.level = t.level AND r.m = regexp_replace(lower(t.mode), '[\s\p{Z}\p{Pd}_]', '', 'g'))
SELECT level, mode FROM cats WHERE available < wanted - 1e-9
"""

_P4 = r"""
WITH one AS (
  SELECT DISTINCT ON (row_id) row_id, source, prompt, completion FROM corpus_row WHERE row_id IS NOT NULL),
toks AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(prompt, ''), '[^\s\p{Z}]+')) + len(regexp_extract_all(coalesce(completion, ''), '[^\s\p{Z}]+'))) AS n
  FROM one GROUP BY source)
SELECT m.source FROM mix_target m LEFT JOIN toks t ON t.source = m.source
WHERE m.max_passes * coalesce(t.n, 0) < m.weight * m.total_tokens - 1e-6
"""

_P8 = r"""
WITH dw AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+12], ' ') AS g FROM dw, unnest(range(1, greatest(1, len(w) - 11))) AS r(i)),
iw AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(prompt), '[\p{L}\p{N}]+') AS w FROM eval_item),
i13 AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') AS g FROM iw, unnest(range(1, greatest(1, len(w) - 11))) AS r(i))
SELECT DISTINCT doc_id, item_id FROM ds JOIN i13 USING (g)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p4_found": _P4, "p8_found": _P8}
