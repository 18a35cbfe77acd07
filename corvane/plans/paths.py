"""Queries about paths, over the distinct paths of the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import paths as op
from corvane.operators.surfaces import LANGUAGES, LOWER, PARTS, STAGES, UPPER, Place, names, with_surfaces
from corvane.plans.general import _key, _path
from corvane.tables import load, norm_key, norm_path


def _paths(spark, folder):
    return load(spark, folder, "file_manifest").select(norm_path("path").alias("path")).where("path is not null").distinct()


def _repo_paths(spark, folder):
    return load(spark, folder, "file_manifest").select(norm_key("repository_id").alias("repository_id"), norm_path("path").alias("path")).where("path is not null and repository_id is not null").distinct()


def path_language(spark, folder):
    return _paths(spark, folder).groupBy(op.language(F.lower("path")).alias("language")).agg(F.count(F.lit(1)).alias("paths"))


def path_predicates(spark, folder):
    """All surfaces of every path."""
    return with_surfaces(_paths(spark, folder), *_FLAGS)


def path_class(spark, folder):
    return with_surfaces(_paths(spark, folder), "path_class")


def path_source_class(spark, folder):
    return with_surfaces(_paths(spark, folder), "source_class")


def subtree_root(spark, folder):
    return _paths(spark, folder).select("path", op.subtree_root(F.col("path")).alias("subtree"))


def path_terms(spark, folder):
    return _paths(spark, folder).select("path", F.array_join(op.path_terms(F.col("path")), " ").alias("terms"), op.file_stem(F.col("path")).alias("stem"))


def family_bits(spark, folder):
    return with_surfaces(_paths(spark, folder), *op.FAMILIES).select("path", op.family_bits().alias("bits"))


def subtree_coverage(spark, folder):
    return op.subtree_coverage(_paths(spark, folder))


def surface_term_weights(spark, folder):
    return op.term_weights(_paths(spark, folder)).select("path", "term", F.col("weight").cast("long").alias("weight"))


def test_subject_links(spark, folder):
    return op.test_subject_links(_repo_paths(spark, folder))


def companion_relations(spark, folder):
    return op.companions(_repo_paths(spark, folder))


QUERIES = {f.__name__: f for f in (path_language, path_predicates, path_class, path_source_class, subtree_root, path_terms, family_bits, subtree_coverage, surface_term_weights, test_subject_links, companion_relations)}
_FLAGS = [n for n in names() if n.startswith("is_")]

_PATHS = f"paths AS (SELECT DISTINCT {_path('path')} AS path FROM file_manifest WHERE path IS NOT NULL)"
_REPO_PATHS = f"paths AS (SELECT DISTINCT {_key('repository_id')} AS repository_id, {_path('path')} AS path FROM file_manifest WHERE path IS NOT NULL AND repository_id IS NOT NULL)"


class SqlPlace(Place):
    """The vocabulary of surfaces in the other dialect."""

    STARTS, ENDS = "starts_with", "ends_with"


def surfaces_sql(table, path="path"):
    """CTEs that end in `surfaces`: the columns of `table` and all surfaces of `path`, stage by stage."""
    low = f"translate({{0}}, '{UPPER}', '{LOWER}')"
    cut = "regexp_replace({0}, '(.)\\.[^.]*$', '\\1')"
    words = "' ' || trim(regexp_replace(" + low.format("regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g')") + ", '[^a-z0-9]+', ' ', 'g')) || ' '"
    out = [f"s0a AS (SELECT *, regexp_replace({path}, '^(\\./)+', '') AS s_path FROM {table})", f"s0b AS (SELECT *, {low.format('s_path')} AS s_low FROM s0a)"]
    name, own = "regexp_extract(s_low, '[^/]*$')", "regexp_extract(s_path, '[^/]*$')"
    out.append(f"s0 AS (SELECT *, {name} AS s_name, {cut.format(name)} AS s_stem, regexp_extract({name}, '.\\.([^.]+)$', 1) AS s_ext, '/' || s_low || '/' AS s_steps, {words.format(cut.format(own))} AS s_words, {words.format('s_low')} AS s_all_words FROM s0b)")
    for i, stage in enumerate(STAGES, 1):
        out.append(f"s{i}x AS (SELECT *, {', '.join(f'{c} AS {n}' for n, c in stage(SqlPlace()).items())} FROM {'s0' if i == 1 else f's{i - 1}x'})")
    out.append(f"surfaces AS (SELECT * EXCLUDE ({', '.join(PARTS)}) FROM s{len(STAGES)}x)")
    return ", ".join(out)


def _language(p):
    return "CASE " + " ".join(f"WHEN ends_with({p}, '{e}') THEN '{n}'" for e, n in LANGUAGES) + " END"


_STEPS = "list_filter(string_split(regexp_replace(path, '^(\\./)+', ''), '/'), lambda s: s <> '')"
_ROLE = "(" + ",".join(f"'{r}'" for r in op.ROLES) + ")"
_SUBTREE = f"""CASE WHEN len({_STEPS}) <= 1 THEN NULL
 WHEN {_STEPS}[1] IN ({','.join(f"'{r}'" for r in op.PACKAGE_ROOTS)}) THEN CASE WHEN {_STEPS}[3] IN {_ROLE} THEN array_to_string({_STEPS}[1:3], '/') ELSE array_to_string({_STEPS}[1:2], '/') END
 WHEN {_STEPS}[1] IN {_ROLE} THEN array_to_string({_STEPS}[1:2], '/') ELSE {_STEPS}[1] END"""


def _stem(p):
    return f"regexp_replace(regexp_extract({p}, '[^/]*$'), '(.)\\.[^.]*$', '\\1')"


def _terms(p):
    """Distinct words in the order they come: the least position of each word, in order."""
    bare = f"regexp_replace({p}, '\\.[^/.]*$', '')"
    cut = f"string_split(trim(lower(regexp_replace(regexp_replace({bare}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    kept = f"list_filter({cut}, lambda t: length(t) >= 2 AND t NOT IN ({','.join(repr(d) for d in op.DULL)}))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


_BITS = " | ".join(f"(CASE WHEN {n} THEN {1 << i} ELSE 0 END)" for i, n in enumerate(op.FAMILIES))
_PATH_SURFACES, _REPO_SURFACES = f"WITH {_PATHS}, {surfaces_sql('paths')}", f"WITH {_REPO_PATHS}, {surfaces_sql('paths')}"
_ALIAS = " UNION ALL ".join(f"SELECT path, '{w}' AS term, 2 AS w FROM surfaces WHERE {n}" for n, words in op.ALIASES.items() for w in words)
_SIGNAL = r"^test_|_test\.|Test\.|\.spec\.|\.test\."
_TEST_STEM = f"""lower(regexp_replace({_stem(r"regexp_replace(path, '\.(spec|test)(\.[^.]*)$', '\2')")}, '^test_|_tests?$|Test$', '', 'g'))"""
_BESIDE = "CASE " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in op.ENTRY_KINDS) + " END"
SQL = {
    "path_language": f"WITH {_PATHS} SELECT {_language('lower(path)')} AS language, count(*) AS paths FROM paths GROUP BY 1",
    "path_predicates": f"{_PATH_SURFACES} SELECT path, {', '.join(_FLAGS)} FROM surfaces",
    "path_class": f"{_PATH_SURFACES} SELECT path, path_class FROM surfaces",
    "path_source_class": f"{_PATH_SURFACES} SELECT path, source_class FROM surfaces",
    "subtree_root": f"WITH {_PATHS} SELECT path, {_SUBTREE} AS subtree FROM paths",
    "path_terms": f"WITH {_PATHS} SELECT path, array_to_string({_terms('path')}, ' ') AS terms, {_stem('path')} AS stem FROM paths",
    "family_bits": f"{_PATH_SURFACES} SELECT path, ({_BITS})::BIGINT AS bits FROM surfaces",
    "subtree_coverage": f"{_PATH_SURFACES}, rows_ AS (SELECT {_SUBTREE} AS subtree, source_class, path FROM surfaces) SELECT subtree, source_class, count(*) AS paths, arg_min(path, (length(path), path)) AS exemplar FROM rows_ WHERE subtree IS NOT NULL GROUP BY 1, 2",
    "surface_term_weights": f"""{_PATH_SURFACES}, t AS (SELECT path, unnest({_terms('path')}) AS term, 3 AS w FROM paths UNION ALL SELECT path, unnest({_terms(_stem('path'))}) AS term, 4 FROM paths
  UNION ALL SELECT path, unnest({_terms('path')}) AS term, 3 FROM surfaces WHERE is_entrypoint UNION ALL {_ALIAS}),
s AS (SELECT path, term, sum(w)::BIGINT AS weight FROM t GROUP BY 1, 2) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY weight DESC, term) <= 24""",
    # Compares every test with every source, which is what the operator avoids; made for small tables.
    "test_subject_links": f"""{_REPO_SURFACES},
r AS MATERIALIZED (SELECT *, {_TEST_STEM} AS stem, {_terms('path')} AS terms,
  (source_class = 'tests' OR is_test_support OR is_test_harness OR regexp_matches(regexp_extract(path, '[^/]*$'), '{_SIGNAL}')) AS test FROM surfaces),
j AS (SELECT t.repository_id, t.path AS test_path, s.path AS subject_path, len(list_intersect(t.terms, s.terms))::INTEGER AS shared, coalesce(t.language = s.language, false) AS same, t.stem = s.stem AND t.stem <> '' AS stems, s.path_class AS kind
  FROM r t JOIN r s ON t.repository_id = s.repository_id AND t.path <> s.path
  WHERE t.test AND NOT s.test AND s.source_class NOT IN ({','.join(repr(c) for c in op.NO_SUBJECTS)}) AND coalesce(t.language = s.language OR (t.language IN ('php','blade') AND s.language IN ('php','blade')), true)),
k AS (SELECT repository_id, test_path, subject_path, shared, (shared * 10 + stems::INTEGER * 6 + same::INTEGER * 3 + CASE kind WHEN 'runtime' THEN 2 WHEN 'support' THEN 1 ELSE 0 END)::INTEGER AS score FROM j WHERE shared > 0),
a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY repository_id, test_path ORDER BY score DESC, subject_path) <= 6)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY repository_id, subject_path ORDER BY score DESC, test_path) <= 6""",
    "companion_relations": f"""{_REPO_SURFACES},
r AS MATERIALIZED (SELECT *, {_SUBTREE} AS subtree, {_BESIDE} AS beside, ({' OR '.join(op.COMPANIONS)}) AS companion, {_terms('path')} AS terms, {_stem('path')} AS stem FROM surfaces),
p AS (SELECT a.repository_id, a.path AS src_path, b.path AS dst_path, b.beside, a.is_entrypoint AND b.beside IS NOT NULL AS one, (a.is_entrypoint OR a.is_runtime_companion) AND b.companion AS two, list_intersect(a.terms, b.terms) AS both_, a.stem = b.stem AND a.stem <> '' AS same, a.stem AS stem, a.source_class = b.source_class AS alike
  FROM r a JOIN r b ON a.repository_id = b.repository_id AND a.subtree = b.subtree AND a.path <> b.path WHERE (a.is_entrypoint OR a.is_runtime_companion) AND (b.beside IS NOT NULL OR b.companion)),
q AS (SELECT *, least(len(both_) + CASE WHEN same AND NOT list_contains(both_, lower(stem)) THEN 1 ELSE 0 END, 8) AS n FROM p WHERE len(both_) > 0 OR same),
u AS (SELECT repository_id, src_path, dst_path, beside AS kind, (100 + n * 12 + same::INTEGER * 18 + alike::INTEGER * 6)::INTEGER AS score FROM q WHERE one QUALIFY row_number() OVER (PARTITION BY repository_id, src_path ORDER BY score DESC, dst_path) <= 8),
v AS (SELECT repository_id, src_path, dst_path, 'companion_surface' AS kind, (80 + same::INTEGER * 20)::INTEGER AS score FROM q WHERE two QUALIFY row_number() OVER (PARTITION BY repository_id, src_path ORDER BY score DESC, dst_path) <= 8)
SELECT repository_id, src_path, dst_path, kind, max(score)::INTEGER AS score FROM (SELECT * FROM u UNION ALL SELECT * FROM v) GROUP BY 1, 2, 3, 4""",
}
