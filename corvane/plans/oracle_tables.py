"""The derived graph tables once more, as common table expressions for the SQL oracle."""

from __future__ import annotations

D = """d AS (
  SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, doc_id AS n,
    'Src' || regexp_extract(source, '([0-9]+)', 1) || '-' || lang || '_PartNo' || CAST(doc_id % 10 AS VARCHAR) AS title,
    'vault/' || CASE WHEN doc_id % 9 = 0 THEN './' ELSE '' END || source || '/doc_' || doc_id || '.md' AS source_path,
    CASE WHEN doc_id % 4 <> 3 THEN 'archived' WHEN doc_id % 20 = 7 THEN 'completed' ELSE 'active' END AS lifecycle_status,
    CASE lang WHEN 'en' THEN 'report' WHEN 'de' THEN 'note' WHEN 'es' THEN 'memo' ELSE 'checklist' END AS doc_type,
    'proj' || doc_id % 5 AS project,
    CASE WHEN toxic = 1 THEN 'failed' WHEN quality IS NULL THEN 'abstraction_skipped' ELSE 'abstraction_complete' END AS pipeline_status,
    CASE WHEN quality = 1 THEN 'complete' ELSE 'unknown' END AS projection_scope,
    CASE WHEN doc_id % 7 <> 0 THEN CAST(DATE '2023-01-01' + CAST(37 * doc_id % 700 AS INTEGER) AS VARCHAR) END AS document_date,
    CASE WHEN doc_id % 3 <> 0 THEN strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id * 53 % 90000), '%Y-%m-%dT%H:%M:%S') END AS source_modified_at,
    CASE WHEN doc_id % 5 = 0 THEN 'team' WHEN doc_id % 5 = 1 THEN '' END AS authority_scope,
    [lang, source, 'pv' || doc_id % 12] AS tags,
    CASE doc_id % 6 WHEN 0 THEN '{"owner":"o' || doc_id % 3 || '","sev":' || doc_id % 4 || '}' WHEN 1 THEN '{"sev":' || doc_id % 4 || '.0}'
      WHEN 2 THEN '{"sev":"' || doc_id % 4 || '"}' WHEN 3 THEN '{"sev":[' || doc_id % 4 || ',"x"]}' WHEN 4 THEN '{"sev":null}' ELSE '{}' END AS tier3,
    sha256(text) AS source_content_hash, sha256(text || chr(10)) AS stored_content_hash,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37 % 100000), '%Y-%m-%dT%H:%M:%S') AS created_at,
    'u' || doc_id % 7 AS created_by, CASE WHEN doc_id % 3 <> 0 THEN 'User ' || doc_id % 7 END AS created_by_name,
    'u' || doc_id % 11 AS last_modified_by, CASE WHEN doc_id % 4 <> 0 THEN 'Editor ' || doc_id % 11 END AS last_modified_by_name,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37 % 100000 + doc_id % 500), '%Y-%m-%dT%H:%M:%S') AS updated_at,
    doc_id % 3 = 0 AS metadata_confirmed, string_split(text, chr(10))[1] AS semantic_abstract, text
  FROM documents LEFT JOIN labels USING (doc_id))"""

E = """e0 AS (SELECT doc_id AS n, (SELECT count(*) FROM documents) AS t FROM documents),
e1 AS (
  SELECT n, t, 'supersedes' AS edge_type, 's' AS mark, n - 1 AS target FROM e0 WHERE n % 4 <> 0
  UNION ALL SELECT n, t, 'supersedes', 'f', n - 3 FROM e0 WHERE n % 40 = 39
  UNION ALL SELECT n, t, 'supersedes', 'c', n + 3 FROM e0 WHERE n % 80 = 76 AND n + 3 < t
  UNION ALL SELECT n, t, 'references', 'r', (7 * n + 3) % t FROM e0 WHERE (7 * n + 3) % t <> n
  UNION ALL SELECT n, t, 'depends_on', 'p', (5 * n + 1) % t FROM e0 WHERE n % 6 = 0 AND (5 * n + 1) % t <> n
  UNION ALL SELECT n, t, 'retracts', 'x', NULL FROM e0 WHERE n % 10 = 9
  UNION ALL SELECT n, t, 'derived_from', 'o', n - 2 FROM e0 WHERE n % 9 = 2
  UNION ALL SELECT n, t, 'sync_target', 'y', n - 4 FROM e0 WHERE n % 15 = 4),
e2 AS (SELECT *, CASE WHEN edge_type IN ('supersedes', 'retracts') THEN 'none' WHEN edge_type = 'derived_from' THEN 'transitive_source' WHEN edge_type = 'sync_target' THEN 'TBD' ELSE 'transitive_both' END AS resolution_policy FROM e1),
e AS (
  SELECT 'e' || n || mark AS id, 'd' || lpad(CAST(n AS VARCHAR), 8, '0') AS source_id, 'd' || lpad(CAST(target AS VARCHAR), 8, '0') AS target_id, edge_type, resolution_policy,
    CASE WHEN resolution_policy LIKE 'trans%' THEN 'd' || lpad(CAST(CASE WHEN n % 11 = 0 THEN (n + 1) % t ELSE n END AS VARCHAR), 8, '0') END AS source_valid_from_version,
    CASE WHEN resolution_policy = 'transitive_both' THEN 'd' || lpad(CAST(target AS VARCHAR), 8, '0') END AS target_valid_from_version,
    CASE WHEN n % 13 = 0 AND edge_type = 'references' THEN 'd' || lpad(CAST(n AS VARCHAR), 8, '0') END AS valid_until_version,
    CASE WHEN edge_type = 'retracts' THEN 'e' || (n - 1) || 'r' END AS retracted_edge_id,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(n % 97 * 10), '%Y-%m-%dT%H:%M:%S') AS created_at,
    CASE WHEN n % 2 = 0 THEN 'inferred:mention' ELSE 'manual' END AS rationale,
    'u' || n % 7 AS created_by, CASE WHEN n % 5 <> 0 THEN 'User ' || n % 7 END AS created_by_name
  FROM e2)"""

P = """p0 AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents),
p AS (
  SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS document_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(chunk_index // 3 AS INTEGER) AS section_index,
    'Src' || regexp_extract(source, '([0-9]+)', 1) || '-' || lang || '_PartNo' || CAST(doc_id % 10 AS VARCHAR) || ' > S' || chunk_index // 3 AS heading_path, content
  FROM p0 WHERE content <> '')"""

V = """v AS (
  SELECT 'd' || lpad(CAST(vec_id % t AS VARCHAR), 8, '0') AS document_id, CAST(CASE WHEN vec_id % 5 = 0 THEN -1 ELSE vec_id // t END AS INTEGER) AS chunk_index,
    vec_id % 5 = 0 AS is_surface, vec_id % 10 = 0 AS authored, embedding, vec_id
  FROM embeddings, (SELECT count(*) AS t FROM documents))"""


def with_tables(sql: str, *tables: str) -> str:
    """``sql`` (further table expressions, then a SELECT) behind the wanted tables."""
    head = ", ".join(tables)
    body = sql.strip()
    return f"WITH RECURSIVE {head}, {body}" if not body.upper().startswith("SELECT") else f"WITH RECURSIVE {head} {body}"
