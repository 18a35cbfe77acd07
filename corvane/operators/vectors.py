"""Vector search by brute force for a stated set of queries, and the bookkeeping around it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one broadcast may hold; larger sets are searched in several passes. Within a pass they are compared `BLOCK` at a time.
QUERY_BLOCK, BLOCK = 20_000, 512


def vector_problem(embedding: Column, dimensions: Column | None = None) -> Column:
    """Why a vector can't be used, or null: missing, empty, dimensions, not_finite, zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = F.when(embedding.isNull(), "missing").when(F.size(embedding) == 0, "empty")
    if dimensions is not None:
        out = out.when(dimensions.isNull() | (F.size(embedding) != dimensions), "dimensions")
    return out.when(~finite, "not_finite").when(~F.exists(embedding, lambda x: x != 0), "zero")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for vectors of length zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest_to_queries(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """The k vectors most like each query: query_id, vec_id, score, rank; itself is left out.

    Both sides have id (long) and v (array of float, usable, of one length). Queries are sent to the
    workers in blocks of bounded size; each task multiplies its vectors with the block and keeps k per
    query, so only k rows a query and task are shuffled. Scores are rounded; of equal scores the
    smaller id comes first.
    """
    spark = vectors.sparkSession
    total = queries.count()
    best = None
    for block in range(max(1, -(-total // QUERY_BLOCK))):
        part = queries if total <= QUERY_BLOCK else queries.where(F.pmod(F.xxhash64("id"), F.lit(-(-total // QUERY_BLOCK))) == block)
        table = part.select("id", "v").toArrow()
        ids = table.column("id").to_numpy()
        matrix = np.array(table.column("v").to_pylist(), dtype=np.float64)
        if len(ids):
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, query = shared.value
            held_ids = np.zeros((len(query_ids), k), np.int64)
            held = np.full((len(query_ids), k), -np.inf)
            for batch in batches:
                if not len(query_ids) or not batch.num_rows:
                    continue
                vec_ids = batch.column(0).to_numpy(zero_copy_only=False)
                in_order = np.argsort(vec_ids, kind="stable")
                vec_ids = vec_ids[in_order]
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(vec_ids), -1).astype(np.float64)[in_order]
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                width = min(k + 1, len(vec_ids))
                for at in range(0, len(query_ids), BLOCK):
                    rows = slice(at, at + BLOCK)
                    score = np.round(query[rows] @ v.T, digits)
                    # One whole number orders by score and then by the smaller id.
                    key = np.rint(score * 10**digits).astype(np.int64) * len(vec_ids) - np.arange(len(vec_ids))
                    top = np.argpartition(-key, width - 1, axis=1)[:, :width]
                    names, value = vec_ids[top], np.take_along_axis(score, top, 1)
                    value[names == query_ids[rows, None]] = -np.inf
                    names, value = np.concatenate([held_ids[rows], names], axis=1), np.concatenate([held[rows], value], axis=1)
                    order = np.lexsort((names, -value), axis=1)[:, :k]
                    held_ids[rows], held[rows] = np.take_along_axis(names, order, 1), np.take_along_axis(value, order, 1)
            rows, cols = np.nonzero(np.isfinite(held))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[rows]), pa.array(held_ids[rows, cols]), pa.array(held[rows, cols])], names=["query_id", "vec_id", "score"])

        found = vectors.select("id", "v").mapInArrow(search, "query_id long, vec_id long, score double")
        best = found if best is None else best.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retained_hits(hits: DataFrame, per_document: int, documents: int, floor: float) -> DataFrame:
    """Hits kept per query: at most `per_document` of one document, of the first `documents` documents, within `floor` of the best score.

    `hits` has query_id, document, vec_id, score. Documents are counted in the order of their best hit.
    """
    in_doc = Window.partitionBy("query_id", "document").orderBy(F.col("score").desc(), "vec_id")
    whole = Window.partitionBy("query_id")
    ranked = hits.withColumn("in_document", F.row_number().over(in_doc)).withColumn("best", F.max("score").over(whole)).withColumn("lead", F.first(F.struct((-F.col("score")).alias("s"), "vec_id")).over(in_doc))
    by_doc = Window.partitionBy("query_id").orderBy("lead")
    kept = ranked.withColumn("document_rank", F.dense_rank().over(by_doc)).where((F.col("in_document") <= per_document) & (F.col("document_rank") <= documents) & (F.col("score") >= F.col("best") * floor))
    return kept.select("query_id", "document", "vec_id", "score", "in_document", "document_rank")


def advance_corpus(stored: DataFrame, incoming: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """A corpus after a partial refresh: rows of changed and removed keys go, incoming rows come; `change` tells kept from new."""
    gone = removed.select(*keys).unionByName(incoming.select(*keys)).distinct()
    return stored.join(gone, keys, "left_anti").withColumn("change", F.lit("kept")).unionByName(incoming.withColumn("change", F.lit("new")))
