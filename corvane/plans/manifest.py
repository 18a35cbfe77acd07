"""Queries about manifests and snapshots."""

from __future__ import annotations

from corvane.operators import manifest as op
from corvane.plans.general import _SERIES, _key, _path
from corvane.tables import load


def _two(spark, folder):
    return load(spark, folder, "snapshot"), load(spark, folder, "file_manifest")


def manifest_diff(spark, folder):
    return op.manifest_diff(*_two(spark, folder))


def snapshot_freshness(spark, folder):
    return op.snapshot_freshness(*_two(spark, folder))


def changed_only_reuse(spark, folder):
    return op.changed_only_reuse(*_two(spark, folder))


def snapshot_retention(spark, folder):
    return op.retained_snapshots(load(spark, folder, "snapshot"))


def manifest_summary(spark, folder):
    return op.manifest_summary(load(spark, folder, "file_manifest"))


def storage_invariants(spark, folder):
    return op.storage_invariants(*_two(spark, folder), load(spark, folder, "embedding_vectors"))


def unscanned_files(spark, folder):
    return op.unscanned_files(load(spark, folder, "file_manifest"), load(spark, folder, "file_content"))


QUERIES = {f.__name__: f for f in (manifest_diff, snapshot_freshness, changed_only_reuse, snapshot_retention, manifest_summary, storage_invariants, unscanned_files)}

_ONCE = f"""rows_all AS (
  SELECT {_key('snapshot_id')} AS snapshot_id, {_path('path')} AS path, lower(sha256) AS digest, size_bytes AS size, mtime_ns AS mtime, delivered_at, {_key('repository_id')} AS rid FROM file_manifest),
files AS (SELECT snapshot_id, path, digest, size, mtime FROM rows_all
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, path ORDER BY delivered_at DESC NULLS LAST, digest DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST, rid DESC NULLS LAST) = 1)"""
_DIM = f"""dim AS (SELECT {_key('snapshot_id')} AS snapshot_id, {_key('worktree')} AS worktree, {_key('kind')} AS kind, {_key('repository_id')} AS repository_id, created_at FROM snapshot
  QUALIFY row_number() OVER (PARTITION BY {_key('snapshot_id')} ORDER BY delivered_at NULLS FIRST, worktree NULLS FIRST, {_key('kind')} NULLS FIRST, {_key('repository_id')} NULLS FIRST, created_at NULLS FIRST) = 1)"""
_PAIRS = f"""{_SERIES}, {_ONCE},
listed AS (SELECT worktree, seq, last_seq, files.* FROM files JOIN series USING (snapshot_id)),
old AS (SELECT worktree, seq + 1 AS seq, path, digest, size, mtime FROM listed WHERE seq < last_seq),
new AS (SELECT worktree, seq, path, digest, size, mtime FROM listed WHERE seq > 1)"""
_SAME = "o.digest IS NOT DISTINCT FROM n.digest AND o.size IS NOT DISTINCT FROM n.size AND o.mtime IS NOT DISTINCT FROM n.mtime"
SQL = {
    "manifest_diff": f"""WITH {_PAIRS},
changes AS (SELECT coalesce(o.worktree, n.worktree) AS worktree, coalesce(o.seq, n.seq) AS seq, coalesce(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
  FROM old o FULL JOIN new n ON o.worktree = n.worktree AND o.seq = n.seq AND o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR NOT ({_SAME}))
SELECT snapshot_id, path, change_type FROM changes JOIN series USING (worktree, seq)""",
    "snapshot_freshness": f"""WITH {_PAIRS},
checked AS (SELECT o.worktree, o.seq, count(*) AS stored, count(*) FILTER (n.path IS NULL OR o.size IS DISTINCT FROM n.size OR o.mtime IS DISTINCT FROM n.mtime) AS stale
  FROM old o LEFT JOIN new n ON o.worktree = n.worktree AND o.seq = n.seq AND o.path = n.path GROUP BY 1, 2)
SELECT snapshot_id, stored, stale, stale = 0 AS valid FROM checked JOIN series USING (worktree, seq)""",
    "changed_only_reuse": f"""WITH {_DIM}, {_ONCE},
part AS (SELECT p.snapshot_id, (SELECT arg_max(f.snapshot_id, (f.created_at, f.snapshot_id)) FROM dim f WHERE f.kind = 'manifest' AND f.worktree = p.worktree AND f.created_at < p.created_at) AS full_id FROM dim p WHERE p.kind = 'changed_only'),
seen AS (SELECT n.snapshot_id, (o.digest IS NOT NULL AND o.size = n.size AND o.mtime = n.mtime) AS reused FROM files n JOIN part USING (snapshot_id) LEFT JOIN files o ON o.snapshot_id = part.full_id AND o.path = n.path)
SELECT snapshot_id, count(*) AS files, count(*) FILTER (reused) AS reused, count(*) - count(*) FILTER (reused) AS rehashed FROM seen GROUP BY 1""",
    "snapshot_retention": f"""WITH {_DIM}
SELECT repository_id, snapshot_id, (row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC NULLS LAST, snapshot_id))::INTEGER AS rank FROM dim WHERE kind = 'manifest' AND repository_id IS NOT NULL QUALIFY rank <= 8""",
    "manifest_summary": f"WITH {_ONCE} SELECT snapshot_id, count(*) AS files, coalesce(sum(size) FILTER (size >= 0), 0)::BIGINT AS bytes, count(DISTINCT digest) AS digests, count(*) FILTER (size = 0) AS empty_files FROM files GROUP BY 1",
    "storage_invariants": f"""WITH {_DIM}
SELECT 'manifest_rows_have_a_snapshot' AS invariant, (SELECT count(*) FROM file_manifest WHERE {_key('snapshot_id')} NOT IN (SELECT snapshot_id FROM dim)) AS violations
UNION ALL SELECT 'full_snapshots_have_rows', (SELECT count(*) FROM dim WHERE kind = 'manifest' AND snapshot_id NOT IN (SELECT {_key('snapshot_id')} FROM file_manifest))
UNION ALL SELECT 'vectors_have_their_dimensions', (SELECT count(*) FROM embedding_vectors WHERE embedding IS NULL OR dimensions IS NULL OR len(embedding) <> dimensions)""",
    "unscanned_files": f"SELECT lower(sha256) AS digest, min({_path('path')}) AS path FROM file_manifest WHERE sha256 IS NOT NULL AND lower(sha256) NOT IN (SELECT lower(sha256) FROM file_content WHERE sha256 IS NOT NULL) GROUP BY 1",
}
