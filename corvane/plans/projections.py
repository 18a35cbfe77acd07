"""Queries about derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import manifest, projections as op
from corvane.plans.general import _key
from corvane.plans.manifest import _DIM
from corvane.plans.paths import SQL as PATH_SQL
from corvane.plans.paths import companion_relations, test_subject_links
from corvane.session import materialise
from corvane.tables import load, norm_key


def overlay_boosts(spark, folder):
    # One after the other: within one plan all their exchanges and broadcasts would be open in the driver at once.
    return op.overlay_boosts(materialise(test_subject_links(spark, folder)), materialise(companion_relations(spark, folder)))


def semantic_status(spark, folder):
    """Repositories that have vectors at all answer with an older snapshot; here no snapshot is embedded itself."""
    latest = manifest.retained_snapshots(load(spark, folder, "snapshot"), 1).select("repository_id", "snapshot_id")
    heads = load(spark, folder, "embedding_vectors").select(norm_key("repository_id").alias("repository_id"), F.lit("").alias("snapshot_id")).distinct()
    return op.semantic_status(heads, latest)


QUERIES = {f.__name__: f for f in (overlay_boosts, semantic_status)}
SQL = {
    "overlay_boosts": f"""WITH l AS ({PATH_SQL['test_subject_links']}), c AS ({PATH_SQL['companion_relations']}),
e AS (SELECT subject_path AS path, score * 10 AS millis, 'test' AS source FROM l UNION ALL SELECT test_path, score * 10, 'subject' FROM l UNION ALL SELECT dst_path, score, kind FROM c)
SELECT path, sum(millis)::BIGINT AS boost, max(millis)::BIGINT AS best, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM e GROUP BY 1""",
    "semantic_status": f"""WITH {_DIM}, latest AS (SELECT repository_id, snapshot_id FROM dim WHERE kind = 'manifest' AND repository_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC NULLS LAST, snapshot_id) = 1)
SELECT repository_id, snapshot_id, CASE WHEN repository_id IN (SELECT {_key('repository_id')} FROM embedding_vectors) THEN 'degraded' ELSE 'unavailable' END AS status FROM latest""",
}
