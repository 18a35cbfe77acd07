"""Queries about vectors. Query sets are the rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import vectors as op
from corvane.tables import load


def _embeddings(spark, folder):
    return load(spark, folder, "embeddings").where(op.vector_problem(F.col("embedding")).isNull()).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _queries(rows):
    return rows.where("id % 100 = 0")


def vector_topk(spark, folder):
    rows = _embeddings(spark, folder)
    return op.nearest_to_queries(rows, _queries(rows), 10)


def vector_topk_filtered(spark, folder):
    """Allowed rows are chosen before the search, so it never returns fewer than it could."""
    rows = _embeddings(spark, folder)
    allowed = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("label")
    return op.nearest_to_queries(rows.join(F.broadcast(allowed), "label", "left_semi").where("label % 2 = 0"), _queries(rows), 5)


def semantic_retention(spark, folder):
    rows = _embeddings(spark, folder)
    hits = vector_topk(spark, folder).join(rows.select(F.col("id").alias("vec_id"), F.col("label").alias("document")), "vec_id")
    return op.retained_hits(hits.select("query_id", "document", "vec_id", "score"), 2, 4, 0.72)


def vector_health(spark, folder):
    vectors = load(spark, folder, "embedding_vectors")
    return vectors.groupBy("model", F.coalesce(op.vector_problem(F.col("embedding"), F.col("dimensions")), F.lit("ok")).alias("state")).agg(F.count(F.lit(1)).alias("vectors"))


def semantic_advance(spark, folder):
    """The chunks of rust files are delivered again; chunks without language are removed."""
    rows = load(spark, folder, "embedding_vectors").select("chunk_id", "vec_id", F.lower("language").alias("language"), "model").where("chunk_id is not null")
    after = op.advance_corpus(rows, rows.where("language = 'rust'"), rows.where("language is null"), ["chunk_id"])
    return after.groupBy("language", "change").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("chunk_id").alias("chunks"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, semantic_retention, vector_health, semantic_advance)}

_FINITE = "list_bool_and(list_transform({e}, lambda x: x IS NOT NULL AND isfinite(x)))"
_GOOD = "good AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0)"
_TOP = """scored AS (SELECT q.id AS query_id, g.id AS vec_id, g.label, round(list_cosine_similarity(q.v, g.v), 4) AS score FROM good q JOIN good g ON g.id <> q.id WHERE q.id % 100 = 0),
top AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)"""
SQL = {
    "vector_topk": f"WITH {_GOOD}, {_TOP} SELECT query_id, vec_id, score, rank FROM top WHERE rank <= 10",
    "vector_topk_filtered": f"""WITH {_GOOD}, {_TOP.replace('WHERE q.id', "WHERE g.label IN (SELECT label FROM good GROUP BY 1 HAVING count(*) >= 20) AND g.label % 2 = 0 AND q.id")} SELECT query_id, vec_id, score, rank FROM top WHERE rank <= 5""",
    "semantic_retention": f"""WITH {_GOOD}, {_TOP}, hits AS (SELECT query_id, label AS document, vec_id, score, max(score) OVER (PARTITION BY query_id) AS best,
  (row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id))::INTEGER AS in_document, min(rank) OVER (PARTITION BY query_id, label) AS lead FROM top WHERE rank <= 10),
k AS (SELECT *, (dense_rank() OVER (PARTITION BY query_id ORDER BY lead))::INTEGER AS document_rank FROM hits)
SELECT query_id, document, vec_id, score, in_document, document_rank FROM k WHERE in_document <= 2 AND document_rank <= 4 AND score >= best * 0.72""",
    "vector_health": f"""SELECT model, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) = 0 THEN 'empty' WHEN dimensions IS NULL OR len(embedding) <> dimensions THEN 'dimensions'
 WHEN NOT {_FINITE.format(e='embedding')} THEN 'not_finite' WHEN list_sum(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)) = 0 THEN 'zero' ELSE 'ok' END AS state, count(*) AS vectors FROM embedding_vectors GROUP BY 1, 2""",
    "semantic_advance": """WITH r AS (SELECT chunk_id, lower(language) AS language FROM embedding_vectors WHERE chunk_id IS NOT NULL),
gone AS (SELECT chunk_id FROM r WHERE language = 'rust' OR language IS NULL),
a AS (SELECT *, 'kept' AS change FROM r WHERE chunk_id NOT IN (SELECT chunk_id FROM gone) UNION ALL SELECT *, 'new' FROM r WHERE language = 'rust')
SELECT language, change, count(*) AS rows, count(DISTINCT chunk_id) AS chunks FROM a GROUP BY 1, 2""",
}
