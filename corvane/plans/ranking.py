"""Queries that fuse evidence: literal matches, path witnesses, neighbours and shared terms of documents."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corvane.operators import graph, paths, ranking as op
from corvane.plans import text as search
from corvane.operators.surfaces import with_surfaces
from corvane.plans.paths import _PATHS, _terms, surfaces_sql
from corvane.plans.text import _MATCHES, _RECALL
from corvane.plans.general import _key
from corvane.tables import load, norm_key, norm_path

#: Words that count as witnesses in a path.
PATH_WORDS = ["digest", "snapshot", "manifest", "graph"]
RULES = [
    op.Rule("readme.prefers", factor=1.45, all_of=("is_readme",)),
    op.Rule("tests.prefers", factor=1.24, all_of=("is_test_support",)),
    op.Rule("fixtures.prefers", factor=1.14, all_of=("is_fixture_support",)),
    op.Rule("noise.penalises", factor=0.08, any_of=("is_ci_workflow", "is_scripts_ops")),
    op.Rule("config.prefers", factor=1.4, add=0.1, all_of=("is_runtime_config_artifact",), none_of=("is_test_support",)),
]


def _docs(spark, folder):
    return load(spark, folder, "documents").select("doc_id", "path", "text")


def evidence(spark, folder):
    """document, line, channel, raw_score, excerpt."""
    docs = _docs(spark, folder)
    hits = search.text_literal_matches(spark, folder)
    frequency = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lexical = hits.groupBy("doc_id", "line").agg(F.min("excerpt").alias("excerpt")).join(frequency, "doc_id").select(F.col("doc_id").alias("document"), "line", F.lit("lexical").alias("channel"), F.sqrt("n").alias("raw_score"), "excerpt")
    shared = F.size(F.array_intersect(paths.path_terms(norm_path("path")), F.array(*map(F.lit, PATH_WORDS))))
    witness = docs.where("path is not null").select(F.col("doc_id").alias("document"), F.lit(1).alias("line"), F.lit("witness").alias("channel"), (shared * 2.0).alias("raw_score"), norm_path("path").alias("excerpt")).where("raw_score > 0")
    recall = search.text_ci_recall_terms(spark, folder).groupBy("doc_id").agg(F.min("line").alias("line"))
    near = _likeness(docs).join(recall, "doc_id")
    semantic = near.select(F.col("doc_id").alias("document"), "line", F.lit("semantic").alias("channel"), "raw_score", F.lit("").alias("excerpt"))
    return lexical.unionByName(witness).unionByName(semantic).unionByName(_neighbours(spark, folder, hits))


def _likeness(docs):
    """Cosine of the words of each text and of the query, as vectors of counts: doc_id, raw_score."""
    words = docs.where("text is not null").select("doc_id", F.explode(F.regexp_extract_all(paths.ascii_lower(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    counts = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    asked = F.when(F.col("word").isin(*[t.lower() for t in search.TERMS]), F.col("n")).otherwise(0)
    return counts.groupBy("doc_id").agg((F.sum(asked) / (F.sqrt(F.sum(F.col("n") * F.col("n"))) * math.sqrt(len(search.TERMS)))).alias("raw_score")).where("raw_score > 0")


def _neighbours(spark, folder, hits):
    """Documents that lie in folders with hits, by the graph of folders and what they contain; a folder weighs as the share of its documents that are hit."""
    path = norm_path("path")
    place = F.concat(F.coalesce(norm_key("repository_id"), F.lit("")), F.lit(":"), F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(""))
    lies = load(spark, folder, "documents").where("path is not null").select(place.alias("src"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("dst"), F.col("doc_id"))
    hit = lies.join(hits.select("doc_id", F.lit(1).alias("hit")).distinct(), "doc_id", "left").groupBy(F.col("src").alias("id")).agg((F.count("hit") / F.count(F.lit(1))).alias("weight")).where("weight > 0")
    reached = graph.graph_hits(hit, lies.select("src", "dst", F.lit("contains").alias("kind")))
    return reached.select(F.substring("id", 5, 30).cast("long").alias("document"), F.lit(1).alias("line"), F.lit("graph").alias("channel"), F.col("score").alias("raw_score"), F.lit("").alias("excerpt"))


def channel_normalise(spark, folder):
    return op.normalise(evidence(spark, folder)).select("document", "line", "channel", F.round("score", 6).alias("score"), "excerpt")


def blend_channels(spark, folder):
    return op.blend(op.normalise(evidence(spark, folder)))


def document_rollup(spark, folder):
    return op.roll_up(blend_channels(spark, folder))


def bounded_anchor_pool(spark, folder):
    return op.bounded_pool(blend_channels(spark, folder), 32).select("document", "line", "blended", "reserve")


def search_hybrid(spark, folder):
    """The first 20 documents in the order of their marks, with what speaks for them."""
    top = op.guarded(document_rollup(spark, folder), search.LITERAL).orderBy(F.col("_order").desc(), "document").limit(20).drop("_order")
    return top.join(_docs(spark, folder).select(F.col("doc_id").alias("document"), norm_path("path").alias("path")), "document")


def channel_counts(spark, folder):
    """What each channel met, and how much of it is among the first 50 documents."""
    final = document_rollup(spark, folder).orderBy(F.col("score").desc(), "document").limit(50)
    return op.channel_counts(evidence(spark, folder), final)


def path_quality(spark, folder):
    rows = load(spark, folder, "file_manifest").select(norm_path("path").alias("path")).where("path is not null").distinct()
    named = list(dict.fromkeys(n for r in RULES for n in (*r.all_of, *r.any_of, *r.none_of)))
    base = F.when(F.col("path_class") == "runtime", 1.0).when(F.col("path_class") == "support", 0.9).otherwise(0.78)
    score, fired = op.apply_rules(base, RULES, {n: F.col(n) for n in named})
    return with_surfaces(rows, "path_class", *named).select("path", F.round(score, 6).alias("quality"), F.array_join(fired, ",").alias("fired"))


QUERIES = {f.__name__: f for f in (channel_normalise, blend_channels, document_rollup, bounded_anchor_pool, search_hybrid, channel_counts, path_quality)}

_PATH = "regexp_replace(replace(path, chr(92), '/'), '^\\./', '')"
_EVIDENCE = f"""{_MATCHES}, {_RECALL},
freq AS (SELECT doc_id, count(*) AS n FROM matches GROUP BY 1),
shared AS (SELECT doc_id, {_PATH} AS p, len(list_intersect({_terms(_PATH)}, [{','.join(repr(w) for w in PATH_WORDS)}])) AS k FROM documents WHERE path IS NOT NULL),
counted AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{paths.UPPER}', '{paths.LOWER}'), '[a-z0-9]+')) AS word FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2),
likeness AS (SELECT * FROM (SELECT doc_id, sum(CASE WHEN word IN ({','.join(repr(t.lower()) for t in search.TERMS)}) THEN n ELSE 0 END)::DOUBLE / (sqrt(sum(n * n)) * {math.sqrt(len(search.TERMS))!r}::DOUBLE) AS raw FROM counted GROUP BY 1) WHERE raw > 0),
lies AS (SELECT doc_id, coalesce({_key('repository_id')}, '') || ':' || CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS id FROM (SELECT *, {_PATH} AS p FROM documents WHERE path IS NOT NULL)),
dense AS (SELECT id, count(*) FILTER (doc_id IN (SELECT doc_id FROM matches)) / count(*) AS weight FROM lies GROUP BY 1),
handed AS (SELECT doc_id, weight * 0.6::DOUBLE AS s FROM lies JOIN dense USING (id) WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, 'doc:' || doc_id) <= 12),
near AS (SELECT doc_id AS document, round(max(s), 6) AS score FROM handed GROUP BY 1),
evidence AS (
  SELECT doc_id AS document, line, 'lexical' AS channel, sqrt(n) AS raw_score, min(excerpt) AS excerpt FROM matches JOIN freq USING (doc_id) GROUP BY 1, 2, 4
  UNION ALL SELECT doc_id, 1, 'witness', k * 2.0::DOUBLE, p FROM shared WHERE k > 0
  UNION ALL SELECT doc_id, first_line, 'semantic', raw, '' FROM likeness JOIN (SELECT doc_id, min(line) AS first_line FROM recall GROUP BY 1) USING (doc_id)
  UNION ALL SELECT document, 1, 'graph', score, '' FROM near),
scored AS (SELECT *, raw_score / max(raw_score) OVER (PARTITION BY CASE WHEN channel IN ('lexical','witness') THEN 'text' ELSE channel END) AS score FROM evidence)"""
_BLEND = f"""{_EVIDENCE},
best AS (SELECT document, line, coalesce(max(score) FILTER (channel = 'lexical'), 0.0)::DOUBLE AS lexical, coalesce(max(score) FILTER (channel = 'witness'), 0.0)::DOUBLE AS witness, coalesce(max(score) FILTER (channel = 'graph'), 0.0)::DOUBLE AS graph, coalesce(max(score) FILTER (channel = 'semantic'), 0.0)::DOUBLE AS semantic,
  string_agg(DISTINCT channel, ',' ORDER BY channel) AS sources,
  arg_max(excerpt, (CASE channel WHEN 'lexical' THEN 4 WHEN 'witness' THEN 3 WHEN 'graph' THEN 2 ELSE 1 END, len(string_split(excerpt, ' ')), excerpt)) AS excerpt FROM scored GROUP BY 1, 2),
blended AS (SELECT document, line, lexical, witness, graph, semantic, sources, round(0.5::DOUBLE * CASE WHEN witness = 0 THEN lexical ELSE 0.7::DOUBLE * lexical + 0.3::DOUBLE * witness END + 0.3::DOUBLE * graph + 0.2::DOUBLE * semantic, 6) AS blended, excerpt FROM best)"""
_ORDER = "blended DESC, lexical DESC, witness DESC, graph DESC, semantic DESC, document, line"
_FOLD = lambda c: f"1 - product(1 - w * {c}) AS {c}"
_ROLL = f"""{_BLEND},
placed AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY {_ORDER}) - 1 AS n FROM blended),
weighed AS (SELECT *, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, least(0.35::DOUBLE, 0.35::DOUBLE / n)) END AS w,
  ((greatest(lexical, witness, graph) > 0)::INTEGER, len(regexp_extract_all(excerpt, '[A-Za-z0-9]{{2,}}')), strlen(excerpt), CASE WHEN lexical > 0 THEN 4 WHEN witness > 0 THEN 3 WHEN graph > 0 THEN 2 WHEN semantic > 0 THEN 1 ELSE 0 END, greatest(round(lexical * 1000), round(witness * 1000), round(graph * 1000)), -n) AS priority FROM placed),
folded AS (SELECT document, {_FOLD('lexical')}, {_FOLD('witness')}, {_FOLD('graph')}, {_FOLD('semantic')}, arg_max(line, priority) AS line, arg_max(excerpt, priority) AS excerpt, count(*)::INTEGER AS anchors FROM weighed GROUP BY 1),
rolled AS (SELECT document, round(0.5::DOUBLE * CASE WHEN witness = 0 THEN lexical ELSE 0.7::DOUBLE * lexical + 0.3::DOUBLE * witness END + 0.3::DOUBLE * graph + 0.2::DOUBLE * semantic, 6) AS score, round(lexical, 6) AS lexical, round(witness, 6) AS witness, round(graph, 6) AS graph, round(semantic, 6) AS semantic, line, excerpt, anchors FROM folded)"""
_MARKS = {"exact_text": f"contains(lower(excerpt), {search.LITERAL.lower()!r}) AND lexical > 0", "strong_text": f"lexical >= {op.STRONG}", "graph": "graph > 0", "more_than_path": f"NOT (lexical = 0 AND graph = 0 AND witness < {op.WEAK})"}
_GUARDED = f"marked AS (SELECT *, {', '.join(f'({c}) AS by_{n}' for n, c in _MARKS.items())} FROM rolled), guarded AS (SELECT *, array_to_string(list_filter([{', '.join(f'CASE WHEN by_{n} THEN {n!r} END' for n in _MARKS)}], lambda x: x IS NOT NULL)[1:3], ',') AS reasons FROM marked)"
_FIRED = ", ".join("CASE WHEN " + (" AND ".join([*(x for x in r.all_of), *([f"({' OR '.join(x for x in r.any_of)})"] if r.any_of else []), *(f"NOT {x}" for x in r.none_of)])) + f" THEN '{r.id}' END" for r in RULES)


def _quality() -> str:
    score = f"CASE WHEN path_class = 'runtime' THEN 1.0::DOUBLE WHEN path_class = 'support' THEN 0.9::DOUBLE ELSE 0.78::DOUBLE END"
    steps = f"{surfaces_sql('paths')}, q0 AS (SELECT path, {score} AS q, [{_FIRED}] AS f FROM surfaces)"
    for i, r in enumerate(RULES):
        steps += f", q{i + 1} AS (SELECT path, CASE WHEN f[{i + 1}] IS NOT NULL THEN q * {r.factor}::DOUBLE + {r.add}::DOUBLE ELSE q END AS q, f FROM q{i})"
    return f"WITH {_PATHS}, {steps} SELECT path, round(q, 6) AS quality, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS fired FROM q{len(RULES)}"


SQL = {
    "channel_normalise": f"WITH {_EVIDENCE} SELECT document, line, channel, round(score, 6) AS score, excerpt FROM scored",
    "blend_channels": f"WITH {_BLEND} SELECT * FROM blended",
    "document_rollup": f"WITH {_ROLL} SELECT * FROM rolled",
    "bounded_anchor_pool": f"""WITH {_BLEND}, base AS (SELECT * FROM blended ORDER BY {_ORDER} LIMIT 32),
firsts AS (SELECT * FROM blended WHERE document NOT IN (SELECT document FROM base) QUALIFY row_number() OVER (PARTITION BY document ORDER BY {_ORDER}) = 1),
more AS (SELECT * FROM firsts ORDER BY {_ORDER} LIMIT 8)
SELECT document, line, blended, false AS reserve FROM base UNION ALL SELECT document, line, blended, true FROM more""",
    "search_hybrid": f"WITH {_ROLL}, {_GUARDED}, top AS (SELECT * FROM guarded ORDER BY {', '.join(f'by_{n} DESC' for n in _MARKS)}, score DESC, lexical DESC, witness DESC, graph DESC, semantic DESC, document LIMIT 20) SELECT t.document, t.score, t.lexical, t.witness, t.graph, t.semantic, t.line, t.excerpt, t.anchors, t.reasons, {_PATH.replace('(path,', '(d.path,')} AS path FROM top t JOIN documents d ON d.doc_id = t.document",
    "channel_counts": f"WITH {_ROLL}, final AS (SELECT document FROM rolled ORDER BY score DESC, document LIMIT 50), met AS (SELECT DISTINCT channel, document FROM evidence WHERE raw_score > 0) SELECT channel, count(*) AS documents, count(*) FILTER (document IN (SELECT document FROM final)) AS final FROM met GROUP BY 1",
    "path_quality": _quality(),
}
