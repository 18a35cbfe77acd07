"""Queries pN_ of the problems about training data. SQL can say few of them; see tests/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.encoding import count_tokens, encode_corpus
from corvane.llm.mixing import mix_sources
from corvane.llm.neighbours import nearest_vectors, similar_pairs
from corvane.llm.provenance import foreign_files
from corvane.llm.residue import find_residue, without_residue
from corvane.llm.splitting import split_items
from corvane.tables import load, norm_digest, norm_path


def _pieces(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    return split_items(load(spark, folder, "file_content"), norm_digest("sha256"), norm_path("path"), F.col("content_text"), with_text=with_text)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, False).where("piece = 0").select(F.col("item").alias("sha256"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, True).withColumnRenamed("item", "sha256")


def p2_nearest(spark: SparkSession, folder: str, min_cosine: float = -1.0) -> DataFrame:
    vectors = load(spark, folder, "embedding_vectors")
    return nearest_vectors(vectors, F.col("vec_id"), [F.col("model")], F.col("embedding"), F.col("dimensions"), min_cosine=min_cosine)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(p2_nearest(spark, folder, 0.85))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    return foreign_files(load(spark, folder, "file_manifest"), load(spark, folder, "snapshot"), load(spark, folder, "file_content"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_classes(spark, folder).select("snapshot_id", "path")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(load(spark, folder, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, folder: str, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    sized = count_tokens(load(spark, folder, "documents"), ["doc_id", "source"], "text")
    return mix_sources(sized, load(spark, folder, "source_weights"), ["doc_id"], total=total)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[1]


def p8_shares_of_total(spark: SparkSession, folder: str) -> DataFrame:
    """A mixture of a million tokens; sources that run out give all they may."""
    return _mixture(spark, folder, 1_000_000)[1]


def p9_cases(spark: SparkSession, folder: str) -> DataFrame:
    return find_residue(load(spark, folder, "documents"), F.col("doc_id"), F.col("text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_cases(spark, folder).select("doc_id")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    return without_residue(load(spark, folder, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_nearest, p3_found, p3_classes, p7_ids, p8_mix, p8_shares, p8_shares_of_total, p9_found, p9_cases, p9_clean)}
_USABLE = """usable AS (SELECT vec_id AS id, model, dimensions, embedding::DOUBLE[] AS v FROM embedding_vectors
  WHERE embedding IS NOT NULL AND dimensions IS NOT NULL AND len(embedding) = dimensions AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
pairs AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM usable a JOIN usable b ON a.model = b.model AND a.dimensions = b.dimensions AND a.id <> b.id)"""
_NEAR = "near AS (SELECT a, b FROM pairs WHERE c >= 0.85 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)"
SQL: dict[str, str] = {
    "p1_found": "SELECT DISTINCT lower(sha256) AS sha256 FROM file_content WHERE strlen(content_text) > 4096",
    # Compares all pairs, which is the point of the operator's index; made for small tables.
    "p2_nearest": f"WITH {_USABLE}, ranked AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b)::INTEGER AS n FROM pairs) SELECT a AS vec_id, b AS neighbour_id, c AS cosine, n AS rank FROM ranked WHERE n <= 5",
    "p2_found": f"WITH {_USABLE}, {_NEAR} SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM near",
}
