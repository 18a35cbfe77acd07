"""Queries about texts: search, positions, caps, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import text as op
from corvane.tables import load

LITERAL, PATTERN, TERMS = "digest", "Refs: #[0-9]+", ["snapshot", "résultats", "fichiers", "Schnappschuss", "ranker"]
KEYS = ["doc_id"]
ORDER = ["doc_id", "line", "column", "excerpt"]


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", "source", "lang", "path", "text")


def text_literal_matches(spark, folder):
    return op.literal_matches(_docs(spark, folder), KEYS, "text", LITERAL)


def text_literal_top(spark, folder):
    """The first 64 matches in total order."""
    return text_literal_matches(spark, folder).orderBy(*ORDER).limit(64)


def text_literal_top_per_file(spark, folder):
    return op.cap_per_key(text_literal_matches(spark, folder), KEYS, ["line", "column", "excerpt"], 3)


def text_regex_with_prefilter(spark, folder):
    return op.regex_matches(_docs(spark, folder), KEYS, "text", PATTERN)


def text_ci_recall_terms(spark, folder):
    return op.lines(_docs(spark, folder), KEYS, "text").where(F.col("body").rlike(op.term_pattern(TERMS))).select("doc_id", "line")


def line_statistics(spark, folder):
    rows = op.lines(_docs(spark, folder), KEYS, "text")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("body")).cast("long").alias("bytes"), F.max(F.octet_length("body")).cast("long").alias("longest"))


def match_frequency(spark, folder):
    return text_literal_matches(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("frequency"), F.countDistinct("line").alias("matched_lines"))


def matched_totals(spark, folder):
    docs = _docs(spark, folder).select("doc_id", "source")
    hits = text_literal_matches(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(hits, "doc_id").groupBy("source").agg(F.sum("n").cast("long").alias("matches"), F.count(F.lit(1)).alias("documents"))


def text_page_after(spark, folder):
    """A page of 20 matches behind document 50, and where the next page starts."""
    return op.page_after(text_literal_matches(spark, folder).drop("excerpt"), ["doc_id", "line", "column"], (50, 1, 1), 20)


def file_slices(spark, folder):
    return op.slice_lines(_docs(spark, folder), KEYS, "text", 3, 12, 600)


def scrubbed_texts(spark, folder):
    scrubbed = op.scrub_leading_comment(F.col("text"))
    return _docs(spark, folder).where("text is not null").select("doc_id", F.md5(scrubbed).alias("digest"), F.octet_length(scrubbed).alias("bytes"))


def merged_matches(spark, folder):
    """Literal matches and lines of term recall, the literal ones first."""
    literal = text_literal_matches(spark, folder).select("doc_id", "line").distinct()
    return op.merge_first_wins(literal, text_ci_recall_terms(spark, folder), keys=["doc_id", "line"])


def recall_minus_literal(spark, folder):
    return text_ci_recall_terms(spark, folder).join(text_literal_matches(spark, folder), ["doc_id", "line"], "left_anti")


QUERIES = {f.__name__: f for f in (text_literal_matches, text_literal_top, text_literal_top_per_file, text_regex_with_prefilter, text_ci_recall_terms, line_statistics, match_frequency, matched_totals, text_page_after, file_slices, scrubbed_texts, merged_matches, recall_minus_literal)}

_LINES = """
pieces AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, len(p) AS n, unnest(p) AS raw, generate_subscripts(p, 1) AS line FROM pieces),
lines AS (SELECT doc_id, line::INTEGER AS line, regexp_replace(raw, '\\r$', '') AS body FROM numbered WHERE raw <> '' OR line < n)"""
_MATCHES = f"""{_LINES},
cut AS (SELECT doc_id, line, body, string_split(body, '{LITERAL}') AS q FROM lines WHERE contains(body, '{LITERAL}')),
spots AS (SELECT *, unnest(range(1, len(q))) AS k FROM cut),
matches AS (SELECT doc_id, line, (list_sum(list_transform(q[1:k], lambda x: strlen(x))) + (k - 1) * {len(LITERAL)} + 1)::INTEGER AS "column", body AS excerpt FROM spots)"""
_TERMS = "(?i)(^|[^\\p{L}\\p{N}_])(" + "|".join(TERMS) + ")([^\\p{L}\\p{N}_]|$)"
_RECALL = f"recall AS (SELECT doc_id, line FROM lines WHERE regexp_matches(body, '{_TERMS}'))"
SQL = {
    "text_literal_matches": f"WITH {_MATCHES} SELECT * FROM matches",
    "text_literal_top": f'WITH {_MATCHES} SELECT * FROM matches ORDER BY doc_id, line, "column", excerpt LIMIT 64',
    "text_literal_top_per_file": f'WITH {_MATCHES} SELECT doc_id, line, "column", excerpt FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line, "column", excerpt) <= 3',
    "text_regex_with_prefilter": f"""WITH {_LINES},
cut AS (SELECT doc_id, line, string_split(regexp_replace(body, '({PATTERN})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS q FROM lines WHERE regexp_matches(body, '{PATTERN}')),
spots AS (SELECT *, unnest(range(2, len(q) + 1)) AS k FROM cut)
SELECT doc_id, line, (list_sum(list_transform(q[1:k-1], lambda x: strlen(replace(x, chr(57345), '')))) + 1)::INTEGER AS "column", string_split(q[k], chr(57345))[1] AS matched FROM spots""",
    "text_ci_recall_terms": f"WITH {_LINES}, {_RECALL} SELECT * FROM recall",
    "line_statistics": f"WITH {_LINES} SELECT doc_id, count(*) AS lines, sum(strlen(body))::BIGINT AS bytes, max(strlen(body))::BIGINT AS longest FROM lines GROUP BY doc_id",
    "match_frequency": f"WITH {_MATCHES} SELECT doc_id, count(*) AS frequency, count(DISTINCT line) AS matched_lines FROM matches GROUP BY doc_id",
    "matched_totals": f"WITH {_MATCHES} SELECT source, count(*) AS matches, count(DISTINCT doc_id) AS documents FROM matches JOIN documents USING (doc_id) GROUP BY source",
    "text_page_after": f"""WITH {_MATCHES}, page AS (SELECT doc_id, line, "column" FROM matches WHERE doc_id > 50 OR (doc_id = 50 AND (line > 1 OR (line = 1 AND "column" >= 1))) ORDER BY 1, 2, 3 LIMIT 21)
SELECT *, row_number() OVER (ORDER BY doc_id, line, "column") > 20 AS resume FROM page""",
    "file_slices": f"""WITH {_LINES},
wanted AS (SELECT doc_id, line, body, sum(strlen(body) + 1) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS used FROM lines WHERE line BETWEEN 3 AND 12)
SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (used <= 600), '') AS content, strlen(string_agg(body, chr(10) ORDER BY line))::INTEGER AS bytes, count(*)::INTEGER AS lines FROM wanted GROUP BY doc_id""",
    "scrubbed_texts": """WITH c AS (SELECT doc_id, text, regexp_extract(text, '^(\\s*<!--(?s:.*?)-->)', 1) AS comment FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN comment = '' THEN text ELSE regexp_replace(comment, '[^\\n]', '', 'g') || substr(text, length(comment) + 1) END AS t FROM c)
SELECT doc_id, md5(t) AS digest, strlen(t)::INTEGER AS bytes FROM s""",
    "merged_matches": f"WITH {_MATCHES}, {_RECALL}, u AS (SELECT DISTINCT doc_id, line, 0 AS part FROM matches UNION ALL SELECT doc_id, line, 1 FROM recall) SELECT doc_id, line, min(part)::INTEGER AS part FROM u GROUP BY doc_id, line",
    "recall_minus_literal": f"WITH {_MATCHES}, {_RECALL} SELECT doc_id, line FROM recall r WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = r.doc_id AND m.line = r.line)",
}
