"""What changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.joins import lookup_join
from corvane.session import materialise
from corvane.tables import compact_digest, norm_key, norm_path


def snapshot_series(snapshots: DataFrame, manifest: DataFrame) -> DataFrame:
    """The full snapshots of each worktree in order: snapshot_id, worktree, seq, last_seq.

    Takes the rows of kind `manifest` whose id has at least one row in `manifest`, ordered by
    created_at and then id. Repeated rows of an id count once (the earliest created_at, then the
    smallest worktree). Rows without id, worktree or created_at have no place in a series.
    """
    full = (
        snapshots.where(norm_key("kind") == "manifest")
        .select(norm_key("snapshot_id").alias("snapshot_id"), norm_key("worktree").alias("worktree"), "created_at")
        .where("snapshot_id is not null and worktree is not null and created_at is not null")
        .groupBy("snapshot_id")
        .agg(F.min(F.struct("created_at", "worktree")).alias("first"))
        .select("snapshot_id", "first.*")
    )
    filled = manifest.select(norm_key("snapshot_id").alias("snapshot_id")).distinct()
    in_order = Window.partitionBy("worktree").orderBy("created_at", "snapshot_id")
    return full.join(filled, "snapshot_id", "left_semi").select(
        "snapshot_id", "worktree",
        F.row_number().over(in_order).alias("seq"),
        F.count(F.lit(1)).over(Window.partitionBy("worktree")).cast("int").alias("last_seq"),
    )


def validity_intervals(manifest: DataFrame, series: DataFrame) -> DataFrame:
    """Islands of an unchanged row: worktree, path, row_hash, start_seq, end_seq, last_seq.

    Gaps and islands over (worktree, path) in the order of the series. One shuffle and one sort
    serve both the choice among repeated rows (the latest delivered_at counts, then the greatest
    digest; a missing delivered_at is the earliest) and the islands. A missing digest equals a
    missing digest. Rows without path are left out.
    """
    rows = manifest.select(
        norm_key("snapshot_id").alias("snapshot_id"), norm_path("path").alias("path"),
        compact_digest("sha256").alias("row_hash"), F.col("delivered_at").alias("came"),
    ).where("snapshot_id is not null and path is not null")
    placed = lookup_join(rows, series.select("snapshot_id", "worktree", "seq", "last_seq"), ["snapshot_id"], salt_on=["path"]).drop("snapshot_id")
    by_key = Window.partitionBy("worktree", "path").orderBy("seq", "came", "row_hash")
    latest = placed.withColumn("next_seq", F.lead("seq").over(by_key)).where("next_seq is null or next_seq <> seq").drop("next_seq", "came")
    in_order = Window.partitionBy("worktree", "path").orderBy("seq")
    starts = latest.withColumn("is_start", F.coalesce((F.lag("seq").over(in_order) != F.col("seq") - 1), F.lit(True)) | ~F.lag("row_hash").over(in_order).eqNullSafe(F.col("row_hash"))).withColumn(
        "is_end", F.coalesce((F.lead("seq").over(in_order) != F.col("seq") + 1), F.lit(True)) | ~F.lead("row_hash").over(in_order).eqNullSafe(F.col("row_hash"))
    )
    # A start row meets the end of its island in the next end row of the same key.
    edges = starts.where("is_start or is_end")
    return (
        edges.withColumn("end_seq", F.when(F.col("is_end"), F.col("seq")).otherwise(F.lead("seq").over(in_order)))
        .where("is_start")
        .select("worktree", "path", "row_hash", F.col("seq").alias("start_seq"), "end_seq", "last_seq")
    )


def snapshot_changes(snapshots: DataFrame, manifest: DataFrame) -> DataFrame:
    """Change events between consecutive full snapshots: snapshot_id, path, change_type.

    A start that adjoins the end of the island before is `modified`, any other start `added` (the
    first snapshot of a series has no events), an end that no start adjoins `deleted` in the next
    snapshot. Only the digest counts. Empty tables give an empty result; columns beyond
    those named are ignored.
    """
    series = materialise(snapshot_series(snapshots, manifest))
    islands = validity_intervals(manifest, series)
    by_key = Window.partitionBy("worktree", "path").orderBy("start_seq")
    linked = islands.withColumn("before_end", F.lag("end_seq").over(by_key)).withColumn("after_start", F.lead("start_seq").over(by_key))
    start = F.when(F.col("start_seq") > 1, F.struct(F.col("start_seq").alias("seq"), F.when(F.col("before_end") == F.col("start_seq") - 1, "modified").otherwise("added").alias("change_type")))
    end = F.when(
        (F.col("end_seq") < F.col("last_seq")) & (F.col("after_start").isNull() | (F.col("after_start") > F.col("end_seq") + 1)),
        F.struct((F.col("end_seq") + 1).alias("seq"), F.lit("deleted").alias("change_type")),
    )
    events = linked.select("worktree", "path", F.explode(F.array_compact(F.array(start, end))).alias("e")).select("worktree", "path", "e.*")
    return lookup_join(events, series.select("worktree", "seq", "snapshot_id"), ["worktree", "seq"], salt_on=["path"]).select("snapshot_id", "path", "change_type")
