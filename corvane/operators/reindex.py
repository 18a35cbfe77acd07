"""Reindexing: what a scan changes, derived anew only for that, published as one version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import materialise
from corvane.sources import sinks


def plan(stored: DataFrame, scan: DataFrame) -> DataFrame:
    """path, change (added, modified, deleted or unchanged) between a stored manifest and a scan (path, sha256, size_bytes, mtime); a changed time alone is a modification."""
    old = stored.select("path", *[F.col(c).alias(f"old_{c}") for c in ("sha256", "size_bytes", "mtime")], F.lit(True).alias("was"))
    new = scan.select("path", "sha256", "size_bytes", "mtime", F.lit(True).alias("now"))
    same = F.col("sha256").eqNullSafe(F.col("old_sha256")) & F.col("size_bytes").eqNullSafe(F.col("old_size_bytes")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return old.join(new, "path", "full").select("path", change.alias("change"))


def counters(planned: DataFrame) -> DataFrame:
    """One row: scanned, added, modified, deleted and unchanged files."""
    count = lambda *kinds: F.count(F.when(F.col("change").isin(*kinds), 1))
    return planned.agg(count("added", "modified", "unchanged").alias("scanned"), *[count(k).alias(k) for k in ("added", "modified", "deleted", "unchanged")])


def diagnostics_by_kind(diagnostics: DataFrame) -> DataFrame:
    """How many problems of each kind: kind, count."""
    return diagnostics.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def merged_diagnostics(*parts: DataFrame) -> DataFrame:
    """Diagnostics of several scans, each once."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def reindex(root: str, snapshot_id: str, scan: DataFrame, derive: dict[str, Callable[[DataFrame], DataFrame]]) -> dict:
    """Bring the tables under `root` up to a scan (path, sha256, size_bytes, mtime, content_text) and publish them together.

    `derive` makes each table (with a column path) from scanned files; it is run only for files that were added or modified, rows of
    the others are taken over, those of deleted files go. Returns version and counters. If anything fails nothing is published and the
    old version stays; if nothing changed there is no new version.
    """
    spark = scan.sparkSession
    before = sinks.head(spark, root)
    manifest = scan.select("path", "sha256", "size_bytes", "mtime")
    stored = sinks.read_head(spark, root, "manifest") if before else manifest.limit(0)
    planned = materialise(plan(stored, manifest))
    told = counters(planned).first().asDict()
    if before and not told["added"] + told["modified"] + told["deleted"]:
        return {"version": before, **told}
    changed = planned.where("change in ('added', 'modified')").select("path")
    gone = planned.where("change <> 'unchanged'").select("path")
    tables = {"manifest": manifest}
    for name, make in derive.items():
        fresh = make(scan.join(changed, "path", "left_semi"))
        kept = sinks.read_head(spark, root, name).join(gone, "path", "left_anti") if before else None
        tables[name] = fresh if kept is None else kept.unionByName(fresh)
    return {"version": sinks.publish(tables, root, snapshot_id, before), **told}
