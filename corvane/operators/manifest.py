"""Manifests: scans compared with what is stored, reuse, freshness, retention, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.joins import lookup_join
from corvane.operators.snapshots import snapshot_series
from corvane.session import materialise
from corvane.tables import norm_digest, norm_key, norm_path


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """One row per snapshot and path, the one delivered last: snapshot_id, path, digest, size, mtime, repository_id."""
    rows = manifest.select(
        norm_key("snapshot_id").alias("snapshot_id"), norm_path("path").alias("path"),
        F.struct(F.col("delivered_at"), norm_digest("sha256").alias("digest"), F.col("size_bytes").alias("size"), F.col("mtime_ns").alias("mtime"), norm_key("repository_id").alias("repository_id")).alias("r"),
    ).where("snapshot_id is not null and path is not null")
    return rows.groupBy("snapshot_id", "path").agg(F.max("r").alias("r")).select("snapshot_id", "path", "r.digest", "r.size", "r.mtime", "r.repository_id")


def snapshot_dim(snapshots: DataFrame) -> DataFrame:
    """One row per snapshot: snapshot_id, worktree, kind, repository_id, created_at (the earliest delivery counts)."""
    rows = snapshots.select(norm_key("snapshot_id").alias("snapshot_id"), F.struct("delivered_at", norm_key("worktree").alias("worktree"), norm_key("kind").alias("kind"), norm_key("repository_id").alias("repository_id"), "created_at").alias("r"))
    return rows.where("snapshot_id is not null").groupBy("snapshot_id").agg(F.min("r").alias("r")).select("snapshot_id", "r.worktree", "r.kind", "r.repository_id", "r.created_at")


def same_file() -> F.Column:
    """Whether digest, size and mtime of two joined rows agree; nothing equals nothing."""
    return F.col("old_digest").eqNullSafe(F.col("digest")) & F.col("old_size").eqNullSafe(F.col("size")) & F.col("old_mtime").eqNullSafe(F.col("mtime"))


def _paired(snapshots: DataFrame, manifest: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
    series = materialise(snapshot_series(snapshots, manifest))
    rows = lookup_join(manifest_rows(manifest).drop("repository_id"), series.select("snapshot_id", "worktree", "seq", "last_seq"), ["snapshot_id"], salt_on=["path"])
    new = rows.where("seq > 1").select("worktree", "seq", "path", "digest", "size", "mtime", F.lit(True).alias("is_new"))
    old = rows.where("seq < last_seq").select("worktree", (F.col("seq") + 1).alias("seq"), "path", F.col("digest").alias("old_digest"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("is_old"))
    return old.join(new, ["worktree", "seq", "path"], how), series


def manifest_diff(snapshots: DataFrame, manifest: DataFrame) -> DataFrame:
    """snapshot_id, path, change_type between consecutive full snapshots; a changed size or mtime alone is a modification too."""
    pairs, series = _paired(snapshots, manifest, "full")
    kind = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "deleted").when(~same_file(), "modified")
    return lookup_join(pairs.withColumn("change_type", kind).where("change_type is not null"), series.select("worktree", "seq", "snapshot_id"), ["worktree", "seq"], salt_on=["path"]).select("snapshot_id", "path", "change_type")


def snapshot_freshness(snapshots: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether the listing before would still do for a snapshot: snapshot_id, stored, stale, valid.

    One-sided: every stored file must still be there with the same size and mtime; new files don't matter.
    """
    pairs, series = _paired(snapshots, manifest, "left")
    stale = F.col("is_new").isNull() | ~F.col("old_size").eqNullSafe(F.col("size")) | ~F.col("old_mtime").eqNullSafe(F.col("mtime"))
    checked = pairs.groupBy("worktree", "seq").agg(F.count(F.lit(1)).alias("stored"), F.sum(stale.cast("long")).alias("stale"))
    return checked.join(series, ["worktree", "seq"]).select("snapshot_id", "stored", "stale", (F.col("stale") == 0).alias("valid"))


def changed_only_reuse(snapshots: DataFrame, manifest: DataFrame) -> DataFrame:
    """What a partial scan may take over from the full listing before: snapshot_id, files, reused, rehashed.

    A digest is reused where the last full snapshot of the worktree has the path with the same size and mtime.
    """
    dim = snapshot_dim(snapshots).where("kind in ('changed_only', 'manifest')")
    # The last full snapshot before is carried forward over the worktree's snapshots in order; of equal times a full one does not count as before.
    w = Window.partitionBy("worktree").orderBy(F.col("created_at").asc_nulls_first(), F.col("kind"), "snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    full = F.when((F.col("kind") == "manifest") & F.col("created_at").isNotNull(), F.col("snapshot_id"))
    carried = dim.withColumn("full_id", F.when(F.col("worktree").isNotNull() & F.col("created_at").isNotNull(), F.last(full, ignorenulls=True).over(w)))
    before = carried.where("kind = 'changed_only'").select("snapshot_id", "full_id")
    rows = manifest_rows(manifest).drop("repository_id")
    new = lookup_join(rows, before, ["snapshot_id"], salt_on=["path"])
    old = lookup_join(rows.withColumnRenamed("snapshot_id", "full_id"), before.select("full_id").where("full_id is not null").distinct(), ["full_id"], salt_on=["path"])
    old = old.select("full_id", "path", F.col("digest").alias("old_digest"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    reused = F.col("old_digest").isNotNull() & (F.col("old_size") == F.col("size")) & (F.col("old_mtime") == F.col("mtime"))
    return new.join(old, ["full_id", "path"], "left").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(reused, 1)).alias("reused")).withColumn("rehashed", F.col("files") - F.col("reused"))


def retained_snapshots(snapshots: DataFrame, keep: int = 8) -> DataFrame:
    """The latest `keep` full snapshots of each repository: repository_id, snapshot_id, rank."""
    w = Window.partitionBy("repository_id").orderBy(F.col("created_at").desc(), "snapshot_id")
    full = snapshot_dim(snapshots).where("kind = 'manifest' and repository_id is not null")
    return full.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("repository_id", "snapshot_id", "rank")


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """snapshot_id, files, bytes of sizes that make sense, digests, empty files."""
    size = F.when(F.col("size") >= 0, F.col("size"))
    return manifest_rows(manifest).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.countDistinct("digest").alias("digests"), F.count(F.when(F.col("size") == 0, 1)).alias("empty_files"))


def storage_invariants(snapshots: DataFrame, manifest: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts that should be zero: invariant, violations."""
    dim = snapshot_dim(snapshots)
    ids = manifest.select(norm_key("snapshot_id").alias("snapshot_id")).where("snapshot_id is not null").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    rows = ids.join(dim, "snapshot_id", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    heads = dim.where("kind = 'manifest'").join(ids, "snapshot_id", "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    sizes = vectors.where("embedding is null or dimensions is null or size(embedding) <> dimensions").agg(F.count(F.lit(1)).alias("violations"))
    named = lambda df, name: df.select(F.lit(name).alias("invariant"), F.col("violations").cast("long"))
    return named(rows, "manifest_rows_have_a_snapshot").unionByName(named(heads, "full_snapshots_have_rows")).unionByName(named(sizes, "vectors_have_their_dimensions"))


def unscanned_files(manifest: DataFrame, contents: DataFrame) -> DataFrame:
    """Distinct digests of the manifest whose text is not at hand, with the least path: digest, path."""
    have = contents.select(norm_digest("sha256").alias("digest")).where("digest is not null").distinct()
    need = manifest.select(norm_digest("sha256").alias("digest"), norm_path("path").alias("path")).where("digest is not null").groupBy("digest").agg(F.min("path").alias("path"))
    return need.join(have, "digest", "left_anti")
