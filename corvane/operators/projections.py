"""Derived tables of a snapshot, boosts they give to paths, and pools chosen with them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import paths as op
from corvane.operators.surfaces import with_surfaces


def bundle(files: DataFrame) -> dict[str, DataFrame]:
    """The projections of a listing (repository_id, path), by name, ready for `sources.sinks.publish`."""
    rows = files.select("repository_id", "path").where("path is not null").distinct()
    told = with_surfaces(rows, "path_class", "source_class", *op.FAMILIES)
    path = F.col("path")
    witness = op.with_facts(told, stem=op.file_stem(path), terms=op.path_terms(path), subtree=op.subtree_root(path), family_bits=op.family_bits()).drop(*op.FAMILIES)
    entry = witness.join(told.where("is_entrypoint").select("repository_id", "path"), ["repository_id", "path"], "left_semi").select("repository_id", "path", "terms", "path_class")
    links = op.test_subject_links(rows)
    relations = op.companions(rows).unionByName(links.select("repository_id", F.col("test_path").alias("src_path"), F.col("subject_path").alias("dst_path"), F.lit("subject").alias("kind"), "score"))
    return {"path_witness": witness, "entrypoint_surface": entry, "test_subject": links, "path_relation": relations, "subtree_coverage": op.subtree_coverage(rows), "surface_terms": op.term_weights(rows)}


def overlay_boosts(links: DataFrame, relations: DataFrame) -> DataFrame:
    """What links and relations add to a path, in thousandths: path, boost, best, sources. Links add their score times ten on both ends, relations their score on the far end."""
    ends = links.select(F.col("subject_path").alias("path"), (F.col("score") * 10).alias("millis"), F.lit("test").alias("source")).unionByName(links.select(F.col("test_path").alias("path"), (F.col("score") * 10).alias("millis"), F.lit("subject").alias("source")))
    far = relations.select(F.col("dst_path").alias("path"), F.col("score").alias("millis"), F.col("kind").alias("source"))
    return ends.unionByName(far).groupBy("path").agg(F.sum("millis").cast("long").alias("boost"), F.max("millis").cast("long").alias("best"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def pivots(ranked: DataFrame, exact_paths: DataFrame) -> DataFrame:
    """How many exact hits stand behind each ranked path: path, exact_hits."""
    return exact_paths.join(ranked.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("exact_hits"))


def grouped_pool(ranked: list[dict], limit: int) -> list[dict]:
    """A bounded pool in rank order: the first `limit` rows, and up to a reserve of later rows whose group is not yet in it. Rows have rank and group."""
    reserve = max(4, min(8, limit))
    rows = sorted(ranked, key=lambda r: r["rank"])
    out = rows[:limit]
    groups = {r["group"] for r in out}
    for row in rows[limit:]:
        if reserve and row["group"] not in groups:
            groups.add(row["group"])
            out.append(row)
            reserve -= 1
    return out


def semantic_status(heads: DataFrame, latest: DataFrame) -> DataFrame:
    """Whether vectors answer for the latest snapshot of each repository: repository_id, snapshot_id, status.

    heads: repository_id, snapshot_id of embedded snapshots; latest: repository_id, snapshot_id. ok where
    the latest is embedded, degraded where only an older one is, else unavailable.
    """
    have = heads.select("repository_id", "snapshot_id", F.lit(True).alias("exact")).distinct()
    some = heads.select("repository_id", F.lit(True).alias("older")).distinct()
    joined = latest.join(have, ["repository_id", "snapshot_id"], "left").join(some, "repository_id", "left")
    return joined.select("repository_id", "snapshot_id", F.when(F.col("exact"), "ok").when(F.col("older"), "degraded").otherwise("unavailable").alias("status"))


def with_handles(matches: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first `limit` matches with handles m1, m2 and so on in their order."""
    top = matches.orderBy(*order).limit(limit)
    return top.withColumn("handle", F.concat(F.lit("m"), F.row_number().over(Window.orderBy(*order))))


def overlay_rows(base: DataFrame, extra: DataFrame, place: list[str]) -> DataFrame:
    """Rows of `extra` at places where `base` has none are added; `added` tells which."""
    return base.withColumn("added", F.lit(False)).unionByName(extra.join(base.select(*place).distinct(), place, "left_anti").withColumn("added", F.lit(True)))


def surface_difference(declared: DataFrame, found: DataFrame) -> DataFrame:
    """What only one of two lists has: the columns and side (declared or found); repetitions count."""
    return declared.exceptAll(found).withColumn("side", F.lit("declared")).unionByName(found.exceptAll(declared).withColumn("side", F.lit("found")))


def hash_embedding(df: DataFrame, key: Column, text: Column, dimensions: int = 64) -> DataFrame:
    """key, embedding: a deterministic unit vector of the words of a text, which stands in for a provider. Each word adds or takes one at a place its hash names; texts without words have the zero vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, dimensions), np.float32)
            for i, scalar in enumerate(batch.column(1)):
                for word in (scalar.as_py() or "").lower().split():
                    if word not in known:
                        digest = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "big")
                        if len(known) > 500_000:
                            known.clear()
                        known[word] = (digest >> 1) % dimensions, 1 if digest & 1 else -1
                    at, sign = known[word]
                    out[i, at] += sign
            length = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
            column = pa.ListArray.from_arrays(np.arange(0, out.size + 1, dimensions, dtype=np.int32), out.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["key", "embedding"])

    rows = df.select(key.alias("key"), text.cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, embedding array<float>")
