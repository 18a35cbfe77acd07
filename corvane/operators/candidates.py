"""Which files a search looks at: the stored listing or a walk, what is added to it, what is tried first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.paths import path_terms
from corvane.operators.surfaces import with_surfaces
from corvane.tables import norm_path

KEYS = ("repository_id", "path")
#: Intents for which hidden workflows, and for which settings at the top, are looked at too.
WORKFLOW_INTENTS, CONFIG_INTENTS = ("entrypoint", "ci"), ("config", "entrypoint")


def universe(manifest: DataFrame, valid: DataFrame, walk: DataFrame | None = None, repositories: list[str] | None = None, language: str | None = None, path_regex: str | None = None) -> DataFrame:
    """repository_id, path, source (manifest or walk) of the files a search may look at, once each.

    manifest: snapshot_id, repository_id, path; valid: repository_id and the snapshot_id whose listing still holds. Repositories
    without a valid snapshot are taken from `walk` (repository_id, path), if given. Filters reach both before they meet.
    """
    listed = manifest.join(valid.select("repository_id", "snapshot_id").distinct(), ["repository_id", "snapshot_id"], "left_semi").select(*KEYS, F.lit("manifest").alias("source"))
    if walk is not None:
        listed = listed.unionByName(walk.join(valid.select("repository_id").distinct(), "repository_id", "left_anti").select(*KEYS, F.lit("walk").alias("source")))
    rows = listed.withColumn("path", norm_path("path")).where("path is not null")
    if repositories is not None:
        rows = rows.where(F.col("repository_id").isin(*repositories))
    if path_regex is not None:
        rows = rows.where(F.col("path").rlike(path_regex))
    rows = rows.groupBy(*KEYS).agg(F.min("source").alias("source"))
    if language is not None:
        rows = with_surfaces(rows, "language").where(F.col("language") == language).select(*KEYS, "source")
    return rows


def with_supplements(base: DataFrame, listing: DataFrame, intents: frozenset[str] | set[str]) -> DataFrame:
    """`base` and what a filter or an ignore rule left out of it but the intents ask for: workflows below .github, and settings at the
    top of a repository. `listing` is all there is (repository_id, path). Adds origin: base, workflow or config; no file twice."""
    out = base.select(*KEYS, F.lit("base").alias("origin"))
    wanted = [(n, o) for n, o, told in (("is_ci_workflow", "workflow", WORKFLOW_INTENTS), ("is_root_scoped_config", "config", CONFIG_INTENTS)) if intents & set(told)]
    if not wanted:
        return out
    rows = with_surfaces(listing.select(*KEYS).distinct(), *[n for n, _ in wanted])
    for name, origin in wanted:
        out = out.unionByName(rows.where(name).select(*KEYS, F.lit(origin).alias("origin")))
    first = F.min(F.struct(F.array_position(F.array(F.lit("base"), F.lit("workflow"), F.lit("config")), F.col("origin")).alias("n"), "origin"))
    return out.groupBy(*KEYS).agg(first["origin"].alias("origin"))


def first_that_finds(attempts: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first result that has rows, else the last; later ones are not even planned."""
    found = attempts[0]()
    for attempt in attempts[1:]:
        if not found.isEmpty():
            return found
        found = attempt()
    return found


def paths_with_terms(files: DataFrame, terms: list[str]) -> DataFrame:
    """Files whose path holds one of the terms, which are tried before all others."""
    low = F.lower("path")
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(low, F.lit(term.lower()))
    return files.where(hit)


def symbols_of_class(symbols: DataFrame, path: str, path_class: str | None = None, path_regex: str | None = None) -> DataFrame:
    """Symbols by the class of their file and a pattern over its path; of runtime files those in test context are left out too."""
    if path_regex is not None:
        symbols = symbols.where(F.col(path).rlike(path_regex))
    if path_class is None:
        return symbols
    told = with_surfaces(symbols.withColumnRenamed("path_class", "_path_class") if "path_class" in symbols.columns else symbols, "path_class", "is_test_support", path=path)
    kept = told.where(F.col("path_class") == path_class)
    if path_class == "runtime":
        in_test = F.lower("canonical").rlike(r"(^|\.)tests?(\.|$)|(^|\.)test_") if "canonical" in symbols.columns else F.lit(False)
        kept = kept.where(~F.col("is_test_support") & ~in_test)
    return kept.drop("path_class", "is_test_support")


def in_latest(hits: DataFrame, latest: DataFrame, fallback: Column) -> DataFrame:
    """Hits of which those from an older snapshot (`fallback` holds) must still be in the latest listing (repository_id, path)."""
    still = hits.join(latest.select(*KEYS, F.lit(True).alias("_still")).distinct(), list(KEYS), "left")
    return still.where(~fallback | F.col("_still").isNotNull()).drop("_still")


def frontier(intents: frozenset[str] | set[str], limit: int) -> int:
    """How many path witnesses are looked at: a multiple of the limit and a least number, the larger the vaguer the intent."""
    # Multiples and least numbers.
    sizes = {"plain": (2, 16), "config": (6, 64), "tests": (8, 80), "entrypoint": (10, 96), "ci": (12, 128)}
    times, least = max((sizes[n] for n in sizes if n in intents), default=sizes["plain"])
    return max(times * limit, least)


def path_witnesses(files: DataFrame, terms: list[str], surface_terms: DataFrame, boosts: DataFrame, limit: int) -> DataFrame:
    """Files ranked by their paths alone: repository_id, path, score, shared, bonus, overlay.

    A shared term counts 1. Weighed terms of the surface (path, term, weight) add a hundredth of their weight, at most 20 of it, and 0.08 if
    a term is met exactly; overlays (path, boost in thousandths) add to whoever has them. Files without any of it are left out.
    """
    asked = F.array(*map(F.lit, terms))
    base = files.select(*KEYS, F.size(F.array_intersect(path_terms(F.col("path")), asked)).alias("shared"))
    weights = surface_terms.where(F.col("term").isin(*terms)).groupBy("path").agg((F.least(F.sum("weight"), F.lit(20)) * 0.01 + 0.08).alias("bonus"))
    met = base.join(weights, "path", "left").join(boosts.select("path", (F.col("boost") / 1000).alias("overlay")), "path", "left")
    score = F.col("shared") + F.coalesce("bonus", F.lit(0.0)) + F.coalesce("overlay", F.lit(0.0))
    told = met.select(*KEYS, F.round(score, 6).alias("score"), "shared", F.round(F.coalesce("bonus", F.lit(0.0)), 6).alias("bonus"), F.round(F.coalesce("overlay", F.lit(0.0)), 6).alias("overlay"))
    return told.where("score > 0").orderBy(F.col("score").desc(), *KEYS).limit(limit)


def seeds(witnesses: DataFrame, limit: int) -> DataFrame:
    """The first `limit` witnesses, of which up to a quarter (2 to 8) of the places go to the best with an overlay that would not be among them."""
    order = [F.col("score").desc(), *KEYS]
    reserve = max(2, min(8, limit // 4))
    ranked = witnesses.orderBy(*order).limit(limit)
    late = witnesses.where("overlay > 0").join(ranked.select(*KEYS), list(KEYS), "left_anti").orderBy(F.col("overlay").desc(), *order).limit(reserve)
    # They take the last places; `limit` bounds all of it.
    first = ranked.orderBy(*order).limit(limit - late.count())
    return first.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))


def coverage_hints(coverage: DataFrame, relations: DataFrame, families: Column) -> DataFrame:
    """What stands for each family and subtree: family, subtree, paths (the exemplars and the far ends of relations, sorted).

    coverage: subtree, source_class, exemplar; relations: dst_path, subtree and what `families` (an array of names) is told by.
    """
    exemplars = coverage.select(F.col("source_class").alias("family"), "subtree", F.col("exemplar").alias("path"))
    ends = relations.select(F.explode(families).alias("family"), "subtree", F.col("dst_path").alias("path"))
    return exemplars.unionByName(ends).where("path is not null").groupBy("family", "subtree").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def relation_terms(relations: DataFrame, surface_terms: DataFrame, terms: list[str]) -> DataFrame:
    """Relations with how much the terms weigh on both ends: adds src_weight, dst_weight; those with neither are left out."""
    weights = surface_terms.where(F.col("term").isin(*terms)).groupBy("path").agg(F.sum("weight").alias("w"))
    src, dst = weights.select(F.col("path").alias("src_path"), F.col("w").alias("src_weight")), weights.select(F.col("path").alias("dst_path"), F.col("w").alias("dst_weight"))
    met = relations.join(src, "src_path", "left").join(dst, "dst_path", "left")
    return met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("src_weight", "dst_weight")}).where("src_weight > 0 or dst_weight > 0")
