"""Queries about chunks and symbols of file_content."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.outline import CLOSER, DECLARATION, KINDS, METHOD
from corvane.operators import chunks, paths, symbols as op
from corvane.plans.general import _path
from corvane.plans.paths import _SUBTREE, _language
from corvane.tables import load, norm_digest, norm_path


def _texts(spark, folder):
    return op.source_texts(load(spark, folder, "file_content"))


def _code(spark, folder):
    return op.source_lines(_texts(spark, folder))


def _spans(spark, folder):
    return op.symbols(_texts(spark, folder))


def chunk_rows(spark, folder):
    once = load(spark, folder, "file_content").where("content_text is not null").groupBy(norm_digest("sha256").alias("sha256")).agg(F.min(F.struct(norm_path("path").alias("path"), "content_text")).alias("r"))
    return chunks.chunk_files(once.select("sha256", "r.*"), F.col("sha256"), F.col("path"), F.col("content_text"))


def chunk_summary(spark, folder):
    return chunks.chunk_summary(chunk_rows(spark, folder))


def symbol_spans(spark, folder):
    return _spans(spark, folder).select("file", "kind", "name", "start_line", "end_line")


def container_span(spark, folder):
    """Every symbol with what lies around it."""
    return _spans(spark, folder).select("file", "name", "start_line", "container", "depth", "canonical")


def document_outline(spark, folder):
    return op.outline_rows(_spans(spark, folder))


def _hits(spark, folder):
    return _code(spark, folder).where(F.contains("body", F.lit("return"))).select("file", "line")


def enclosing_symbol(spark, folder):
    return op.enclosing_symbol(_hits(spark, folder), _spans(spark, folder))


def symbol_at_or_before(spark, folder):
    return op.symbol_at_or_before(_hits(spark, folder), _spans(spark, folder))


def symbol_search_rank(spark, folder):
    """All that is named like the word searched for, in any way."""
    return op.symbol_rank(_spans(spark, folder), SEARCHED)


def symbol_search_top(spark, folder):
    """The best forty for one name."""
    return op.search_symbols(_spans(spark, folder), SEARCHED, 40)


def symbol_prefix_rank(spark, folder):
    return op.symbol_rank(_spans(spark, folder), "Merge_")


def symbol_inventory(spark, folder):
    """How many symbols of each name, whatever case, stand in how many files."""
    return _spans(spark, folder).groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file").alias("files"))


def symbol_overlap(spark, folder):
    """Files that declare symbols of one name in a subtree."""
    texts = _texts(spark, folder)
    return paths.name_overlap(_spans(spark, folder).join(texts.select("file", norm_path("path").alias("path")), "file").where("path <> ''"))


def call_edges(spark, folder):
    return op.calls(_code(spark, folder), _spans(spark, folder))


def symbol_references(spark, folder):
    return op.references(_code(spark, folder), _spans(spark, folder))


SEARCHED = "digest"
QUERIES = {f.__name__: f for f in (chunk_rows, chunk_summary, symbol_spans, container_span, document_outline, enclosing_symbol, symbol_at_or_before, symbol_search_rank, symbol_search_top, symbol_prefix_rank, symbol_inventory, symbol_overlap, call_edges, symbol_references)}

_CODE = """texts AS MATERIALIZED (SELECT lower(sha256) AS file, arg_min(content_text, (coalesce(path, ''), content_text)) AS text, min(coalesce(path, '')) AS path FROM file_content WHERE sha256 IS NOT NULL AND content_text IS NOT NULL GROUP BY 1),
pieces AS (SELECT file, string_split(text, chr(10)) AS p FROM texts),
numbered AS (SELECT file, len(p) AS n, unnest(p) AS raw, generate_subscripts(p, 1) AS line FROM pieces),
code AS MATERIALIZED (SELECT file, line::INTEGER AS line, regexp_replace(raw, '\\r$', '') AS body FROM numbered WHERE raw <> '' OR line < n)"""
_DECLARES = f"(regexp_matches(body, '{DECLARATION}') OR regexp_matches(body, '{METHOD}'))"
_WORD = "CASE word " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " ELSE word END"
_SYMBOLS = f"""{_CODE},
solid AS MATERIALIZED (SELECT file, line, body, length(regexp_extract(body, '^[ \\t]*')) AS indent, NOT regexp_matches(body, '{CLOSER}') AS ends FROM code WHERE regexp_matches(body, '\\S')),
found AS MATERIALIZED (SELECT file, line, indent, regexp_extract(body, '{DECLARATION}', 1) AS word, regexp_extract(body, '{DECLARATION}', 2) AS named, regexp_extract(body, '{METHOD}', 1) AS method FROM solid WHERE {_DECLARES}),
stop AS (SELECT f.file, f.line, min(s.line) AS at FROM found f JOIN solid s ON s.file = f.file AND s.line > f.line AND (s.indent < f.indent OR (s.indent = f.indent AND s.ends)) GROUP BY 1, 2),
reach AS (SELECT f.file, f.line, max(s.line) AS last FROM found f LEFT JOIN stop t ON t.file = f.file AND t.line = f.line JOIN solid s ON s.file = f.file AND s.line >= f.line AND (t.at IS NULL OR s.line < t.at) GROUP BY 1, 2),
spans AS MATERIALIZED (SELECT file, CASE WHEN word <> '' THEN {_WORD} ELSE 'method' END AS kind, CASE WHEN word <> '' THEN named ELSE method END AS name, line AS start_line, last::INTEGER AS end_line FROM found JOIN reach USING (file, line)),
nested AS MATERIALIZED (SELECT d.file, d.kind, d.name, d.start_line, d.end_line, arg_max(c.name, c.start_line) AS container, max(c.start_line) AS parent_start, count(c.name)::INTEGER AS depth, coalesce(string_agg(c.name, '.' ORDER BY c.start_line) || '.', '') || d.name AS canonical
  FROM spans d LEFT JOIN spans c ON c.file = d.file AND c.start_line < d.start_line AND c.end_line >= d.start_line GROUP BY 1, 2, 3, 4, 5)"""
_RANK = "CASE WHEN depth > 0 AND canonical = '{q}' THEN 0 WHEN depth > 0 AND lower(canonical) = lower('{q}') THEN 1 WHEN depth > 0 AND starts_with(lower(canonical), lower('{q}')) THEN 2 WHEN name = '{q}' THEN 3 WHEN lower(name) = lower('{q}') THEN 4 WHEN starts_with(lower(name), lower('{q}')) THEN 5 WHEN contains(lower(name), lower('{q}')) THEN 6 END"
_RANKED = "r AS (SELECT file, name, canonical, kind, start_line, " + _RANK + "::INTEGER AS rank FROM nested)"
_HITS = "hits AS (SELECT file, line FROM code WHERE contains(body, 'return'))"
_INNER = "SELECT file, line, arg_max(name, start_line) AS name, arg_max(kind, start_line) AS kind, max(start_line) AS start_line FROM {h} JOIN {s} spans USING (file) WHERE line BETWEEN start_line AND end_line GROUP BY 1, 2"
_QUOTED = '"[^"]*"|' + "''[^'']*''"
SQL = {
    "symbol_spans": f"WITH {_SYMBOLS} SELECT * FROM spans",
    "container_span": f"WITH {_SYMBOLS} SELECT file, name, start_line, container, depth, canonical FROM nested",
    "document_outline": f"WITH {_SYMBOLS}, placed AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start_line)::INTEGER AS place FROM nested) SELECT a.file, a.place, coalesce(b.place, 0)::INTEGER AS parent_place, a.depth, a.kind, a.name, a.start_line, a.end_line FROM placed a LEFT JOIN placed b ON a.file = b.file AND a.parent_start = b.start_line",
    "enclosing_symbol": f"WITH {_SYMBOLS}, {_HITS}, best AS ({_INNER.format(h='hits', s='spans')}) SELECT file, line, name, kind FROM hits LEFT JOIN best USING (file, line)",
    "symbol_at_or_before": f"""WITH {_SYMBOLS}, {_HITS}, best AS ({_INNER.format(h='hits', s='spans')}),
near AS (SELECT h.file, h.line, s.name, s.start_line FROM hits h ASOF LEFT JOIN spans s ON h.file = s.file AND h.line >= s.start_line)
SELECT n.file, n.line, coalesce(b.name, n.name) AS name, coalesce(n.line - coalesce(b.start_line, n.start_line), -1)::INTEGER AS distance, b.name IS NOT NULL AS inside FROM near n LEFT JOIN best b ON b.file = n.file AND b.line = n.line""",
    "symbol_search_rank": f"WITH {_SYMBOLS}, {_RANKED.format(q=SEARCHED)} SELECT * FROM r WHERE rank IS NOT NULL",
    "symbol_search_top": f"WITH {_SYMBOLS}, {_RANKED.format(q=SEARCHED)} SELECT * FROM r WHERE rank IS NOT NULL ORDER BY rank, file, start_line, kind, name LIMIT 40",
    "symbol_prefix_rank": f"WITH {_SYMBOLS}, {_RANKED.format(q='Merge_')} SELECT * FROM r WHERE rank IS NOT NULL",
    "symbol_inventory": f"WITH {_SYMBOLS} SELECT lower(name) AS name, count(*) AS symbols, count(DISTINCT file) AS files FROM spans GROUP BY 1",
    "symbol_overlap": f"""WITH {_SYMBOLS}, told AS (SELECT file, {_path('path')} AS path FROM texts),
named AS MATERIALIZED (SELECT DISTINCT path, {_SUBTREE} AS subtree, {_language('lower(path)')} AS language, lower(s.name) AS name FROM spans s JOIN told USING (file) WHERE path <> ''),
pairs AS (SELECT a.path AS src_path, b.path AS dst_path, max(96 + CASE WHEN a.language = b.language THEN 8 ELSE 0 END)::INTEGER AS score FROM named a JOIN named b ON a.subtree = b.subtree AND a.name = b.name AND a.path <> b.path GROUP BY 1, 2)
SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY src_path ORDER BY score DESC, dst_path) <= 8""",
    "call_edges": f"""WITH {_SYMBOLS},
bare AS (SELECT file, line, regexp_replace(body, '{_QUOTED}', '', 'g') AS body FROM code WHERE contains(body, '(') AND NOT {_DECLARES} AND NOT regexp_matches(body, '{op.COMMENT}')),
used AS (SELECT file, line, unnest(list_transform(list_filter(regexp_extract_all(body, '{op.WORD}', 1), lambda w: ends_with(w, '(') AND NOT (w[1] BETWEEN '0' AND '9')), lambda w: rtrim(w, '('))) AS callee FROM bare),
known AS MATERIALIZED (SELECT * FROM used WHERE callee NOT IN ({', '.join(repr(w) for w in op.NO_CALLS)})),
best AS ({_INNER.format(h='(SELECT DISTINCT file, line FROM known)', s="(SELECT * FROM spans WHERE kind IN ('function', 'method'))")})
SELECT file, name AS caller, callee, count(*) AS calls FROM known JOIN best USING (file, line) GROUP BY 1, 2, 3""",
    "symbol_references": f"""WITH {_SYMBOLS},
words AS (SELECT file, line, rtrim(unnest(regexp_extract_all(body, '{op.WORD}', 1)), '(') AS name FROM code)
SELECT name, count(*) AS refs, count(DISTINCT file) AS files FROM words w WHERE name IN (SELECT name FROM spans) AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.file = w.file AND s.start_line = w.line AND s.name = w.name) GROUP BY 1""".replace("AS refs", 'AS "references"'),
}
