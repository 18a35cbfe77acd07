"""Queries pN_ of the general problems, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.nested import leaf_statistics, nested_objects, nested_rows, nested_values, records, shred
from corvane.operators.references import orphan_references, orphan_report
from corvane.operators.snapshots import snapshot_changes, snapshot_series, validity_intervals
from corvane.tables import load, norm_key, norm_path


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(load(spark, folder, "snapshot"), load(spark, folder, "file_manifest"))


def p4_intervals(spark: SparkSession, folder: str) -> DataFrame:
    manifest = load(spark, folder, "file_manifest")
    return validity_intervals(manifest, snapshot_series(load(spark, folder, "snapshot"), manifest)).select("worktree", "path", F.lower(F.hex("row_hash")).alias("sha256"), "start_seq", "end_seq")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    events, grammars = load(spark, folder, "provenance_event"), load(spark, folder, "node_types")
    # An unknown call index leaves its place in the id empty.
    event_id = F.concat("trace_id", F.lit("#"), F.coalesce(F.col("call_index").cast("string"), F.lit("")))
    return records(events, "provenance_event", event_id, F.col("payload_json")).unionByName(records(grammars, "node_types", F.col("grammar"), F.col("node_types_json")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested_objects(_records(spark, folder))


def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    return nested_values(_records(spark, folder))


def p5_rows(spark: SparkSession, folder: str) -> DataFrame:
    return nested_rows(_records(spark, folder))


def p5_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of all records with their levels, by leaf path."""
    return leaf_statistics(shred(_records(spark, folder)))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    repository, snapshot, manifest = (load(spark, folder, t) for t in ("repository", "snapshot", "file_manifest"))
    snapshot_key, repository_key, gone = norm_key("snapshot_id"), norm_key("repository_id"), F.col("deleted_at")
    at = F.col("delivered_at")
    return orphan_references(snapshot, repository, "snapshot", repository_key, snapshot_key, at, repository_key, F.col("created_at"), gone).unionByName(
        orphan_references(manifest, snapshot, "file_manifest", snapshot_key, norm_path("path"), at, snapshot_key, at, gone)
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).drop("rows")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder))


QUERIES = {f.__name__: f for f in (p4_found, p4_intervals, p5_found, p5_values, p5_rows, p5_levels, p6_found, p6_report)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def _key(col: str) -> str:
    return f"lower(trim({col}, {_BLANKS}))"


def _path(col: str) -> str:
    return f"regexp_replace(replace({col}, chr(92), '/'), '^\\./', '')"


_SERIES = f"""
full_rows AS (
  SELECT {_key('snapshot_id')} AS snapshot_id, {_key('worktree')} AS worktree, min(created_at) AS created_at
  FROM snapshot WHERE {_key('kind')} = 'manifest' GROUP BY 1, 2),
series AS (
  SELECT *, row_number() OVER (PARTITION BY worktree ORDER BY created_at, snapshot_id) AS seq,
         count(*) OVER (PARTITION BY worktree) AS last_seq
  FROM full_rows WHERE snapshot_id IN (SELECT {_key('snapshot_id')} FROM file_manifest)),
rows_once AS (
  SELECT {_key('snapshot_id')} AS snapshot_id, {_path('path')} AS path, arg_max(lower(sha256), (delivered_at, lower(sha256))) AS sha256
  FROM file_manifest GROUP BY 1, 2),
placed AS (SELECT worktree, path, seq, last_seq, sha256 FROM rows_once JOIN series USING (snapshot_id))"""

SQL = {
    "p4_found": f"""
WITH {_SERIES},
pairs AS (
  SELECT coalesce(b.worktree, a.worktree) AS worktree, coalesce(b.seq, a.seq + 1) AS seq, coalesce(b.path, a.path) AS path,
         CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
  FROM placed a FULL JOIN placed b ON a.worktree = b.worktree AND a.path = b.path AND b.seq = a.seq + 1
  WHERE (b.path IS NULL AND a.seq < a.last_seq) OR (a.path IS NULL AND b.seq > 1) OR a.sha256 <> b.sha256)
SELECT snapshot_id, path, change_type FROM pairs JOIN series USING (worktree, seq)""",
    "p4_intervals": f"""
WITH {_SERIES},
marked AS (
  SELECT *, seq - row_number() OVER (PARTITION BY worktree, path, sha256 ORDER BY seq) AS island FROM placed)
SELECT worktree, path, sha256, min(seq)::INTEGER AS start_seq, max(seq)::INTEGER AS end_seq
FROM marked GROUP BY worktree, path, sha256, island""",
}

_ORPHANS = f"""
refs AS (
  SELECT 'snapshot' AS table_name, {_key('repository_id')} AS missing_key, {_key('snapshot_id')} AS referring_key, date_trunc('month', delivered_at) AS m FROM snapshot
  UNION ALL
  SELECT 'file_manifest', {_key('snapshot_id')}, {_path('path')}, date_trunc('month', delivered_at) FROM file_manifest),
parents AS (
  SELECT 'snapshot' AS table_name, {_key('repository_id')} AS k, created_at AS came, deleted_at AS gone FROM repository
  UNION ALL
  SELECT 'file_manifest', {_key('snapshot_id')}, delivered_at, deleted_at FROM snapshot),
orphans AS (
  SELECT table_name, missing_key, referring_key, strftime(m, '%Y-%m') AS period FROM refs
  WHERE missing_key IS NOT NULL AND m IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.table_name = refs.table_name AND p.k = missing_key
      AND p.came < m + INTERVAL 1 MONTH AND (p.gone IS NULL OR p.gone >= m + INTERVAL 1 MONTH)))"""

SQL |= {
    "p6_found": f"WITH {_ORPHANS} SELECT DISTINCT table_name, missing_key, referring_key, period FROM orphans",
    "p6_report": f"""WITH {_ORPHANS}
SELECT table_name, period, count(DISTINCT missing_key) AS missing_keys, count(*) AS referring_rows FROM orphans GROUP BY 1, 2""",
}

# Walks the values of all payloads. `own` is the place of the nearest object around or of the value itself if it is one, `row` that of the
# nearest list element, `tab` and `rtab` their places in the schema.
_POINTER = "replace(replace({0}, '~', '~0'), '/', '~1')"
_KEPT = "source_table, record_id, ptr, tab, own, row_, rtab"
_WALK = f"""RECURSIVE raw AS (
  SELECT 'provenance_event' AS source_table, trace_id || '#' || coalesce(call_index::VARCHAR, '') AS record_id, payload_json AS p FROM provenance_event
  UNION ALL SELECT 'node_types', grammar, node_types_json FROM node_types),
once AS (SELECT source_table, record_id, p::JSON AS j FROM raw WHERE p IS NOT NULL AND json_valid(p)),
twice AS (SELECT source_table, record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END AS j FROM once),
walk AS (
  SELECT DISTINCT source_table, record_id, '' AS ptr, '' AS tab, '' AS own, '' AS around, '' AS row_, '' AS rtab, '' AS prow, '' AS ptab, 0 AS elem, j AS v FROM twice WHERE j IS NOT NULL
  UNION ALL
  SELECT source_table, record_id, ptr || step, tab || named, CASE WHEN json_type(w) = 'OBJECT' THEN ptr || step ELSE own END, own,
    CASE WHEN e = 1 THEN ptr || step ELSE row_ END, CASE WHEN e = 1 THEN tab || named ELSE rtab END, row_, rtab, e, w
  FROM (
    SELECT {_KEPT}, '/' || {_POINTER.format('name')} AS step, '/' || {_POINTER.format('name')} AS named, 0 AS e, json_extract(v, '/' || {_POINTER.format('name')}) AS w
      FROM (SELECT *, unnest(json_keys(v)) AS name FROM walk WHERE json_type(v) = 'OBJECT')
    UNION ALL
    SELECT {_KEPT}, '/' || n, '/[]', 1, json_extract(v, '/' || n) FROM (SELECT *, unnest(range(json_array_length(v)::BIGINT)) AS n FROM walk WHERE json_type(v) = 'ARRAY')))"""
SQL |= {
    "p5_found": f"WITH {_WALK} SELECT DISTINCT source_table, record_id, ptr AS node_path, around AS parent_path FROM walk WHERE json_type(v) = 'OBJECT' AND ptr <> ''",
    "p5_rows": f'WITH {_WALK} SELECT DISTINCT source_table, record_id, rtab AS "table", row_ AS row_path, ptab AS parent_table, prow AS parent_path FROM walk WHERE elem = 1',
    "p5_values": f"""WITH {_WALK} SELECT DISTINCT source_table, record_id, around AS object_path, substr(ptr, length(around) + 1) AS field,
  CASE json_type(v) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind, v ->> '$' AS value FROM walk WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')""",
}
