"""Queries that navigate an index told by the texts of file_content."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import navigation as op, symbols
from corvane.plans.symbols import SQL as SYMBOL_SQL
from corvane.plans.symbols import _SYMBOLS, _code, _spans
from corvane.session import materialise

QUERY, FALLBACK = "ATTACH_NIMBUS_DIGEST", "apply_sable_query"


def _index(spark, folder):
    return op.text_index(_code(spark, folder), _spans(spark, folder))


def precise_symbol_rank(spark, folder):
    """Symbols that answer a name or, failing that, a shorter one."""
    return op.name_rank(_index(spark, folder)["symbols"], QUERY, FALLBACK).select("path", "symbol", "display_name", "kind", "rank")


def definitions_of_uses(spark, folder):
    index = _index(spark, folder)
    return op.definitions_of_uses(materialise(index["occurrences"]), index["symbols"])


def symbol_at_location(spark, folder):
    """For every line that returns something, its column 12."""
    index = _index(spark, folder)
    places = _code(spark, folder).where(F.contains("body", F.lit("return"))).select(F.col("file").alias("path"), "line", F.lit(12).alias("column"))
    return op.symbol_at(materialise(index["occurrences"]), index["symbols"], places)


def go_to_definition(spark, folder):
    """All names that are called, by the index or by declarations of any file."""
    index, spans = _index(spark, folder), _spans(spark, folder)
    names = symbols.calls(_code(spark, folder), spans).select(F.col("callee").alias("name"))
    exact = op.definitions(index["occurrences"], index["symbols"]).where("kind <> 'method'")
    return op.go_to_definition(exact, spans, names)


QUERIES = {f.__name__: f for f in (precise_symbol_rank, definitions_of_uses, symbol_at_location, go_to_definition)}

_INDEX = f"""{_SYMBOLS},
named AS MATERIALIZED (SELECT file AS path, 'text ' || file || '#' || canonical || '@' || start_line || '.' AS symbol, name AS display_name, kind, start_line FROM nested),
words AS (SELECT DISTINCT file AS path, line, body, rtrim(unnest(regexp_extract_all(body, '{symbols.WORD}', 1)), '(') AS display_name FROM code),
here AS (SELECT path, display_name, arg_max(symbol, start_line) AS own FROM named GROUP BY 1, 2),
only_ AS (SELECT display_name, min(symbol) AS other FROM named GROUP BY 1 HAVING count(*) = 1),
used AS (SELECT w.path, w.line, w.body, w.display_name, coalesce(own, other) AS symbol FROM words w LEFT JOIN here USING (path, display_name) LEFT JOIN only_ USING (display_name)
  WHERE coalesce(own, other) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM named n WHERE n.path = w.path AND n.start_line = w.line AND n.display_name = w.display_name)),
occurrences AS MATERIALIZED (SELECT n.path, n.symbol, n.start_line AS line, strpos(c.body, n.display_name) AS col, strpos(c.body, n.display_name) + length(n.display_name) AS end_col, true AS is_definition FROM named n JOIN code c ON c.file = n.path AND c.line = n.start_line
  UNION ALL SELECT path, symbol, line, strpos(body, display_name), strpos(body, display_name) + length(display_name), false FROM used),
defined AS (SELECT o.symbol, arg_min(o.path, (o.path, o.line, o.col)) AS path, min((o.path, o.line, o.col)).line AS line FROM (SELECT symbol, path, line, col FROM occurrences WHERE is_definition) o GROUP BY 1)"""
_TAIL = "regexp_extract(symbol, '([A-Za-z0-9_]+)[^A-Za-z0-9_]*$', 1)"
_RANKS = " ".join(f"WHEN display_name = '{n}' THEN {4 * i + 1} WHEN {_TAIL} = '{n}' THEN {4 * i + 2} WHEN lower(display_name) = '{n.lower()}' THEN {4 * i + 3} WHEN lower({_TAIL}) = '{n.lower()}' THEN {4 * i + 4}" for i, n in enumerate((QUERY, FALLBACK)))
SQL = {
    "precise_symbol_rank": f"WITH {_INDEX} SELECT * FROM (SELECT path, symbol, display_name, kind, (CASE WHEN symbol = '{QUERY}' THEN 0 {_RANKS} END)::INTEGER AS rank FROM named) WHERE rank IS NOT NULL",
    "definitions_of_uses": f"WITH {_INDEX} SELECT o.path, o.line::INTEGER AS start_line, o.col::INTEGER AS start_column, o.symbol, n.display_name, n.path AS defined_in, n.start_line::INTEGER AS defined_at, o.path = n.path AS same_file FROM occurrences o JOIN named n USING (symbol) WHERE NOT o.is_definition",
    "symbol_at_location": f"""WITH {_INDEX}, places AS (SELECT file AS path, line FROM code WHERE contains(body, 'return')),
met AS (SELECT p.path, p.line, o.symbol, NOT (o.line = p.line AND 12 < o.end_col) AS outside, p.line - o.line AS lines, CASE WHEN p.line = o.line THEN 12 - o.col ELSE 0 END AS columns_, o.line AS oline, o.col AS ocol FROM places p JOIN occurrences o ON o.path = p.path AND o.line <= p.line AND (o.line < p.line OR o.col <= 12)),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY outside, lines, columns_, oline DESC, ocol DESC, symbol) = 1)
SELECT p.path, p.line, 12 AS "column", b.symbol, coalesce(NOT b.outside, false) AS contained FROM places p LEFT JOIN best b USING (path, line)""",
    "go_to_definition": f"""WITH {_SYMBOLS}, asked AS (SELECT DISTINCT callee AS name FROM ({SYMBOL_SQL['call_edges']})),
first AS (SELECT name, file AS path, start_line AS line, kind, row_number() OVER (PARTITION BY name, kind <> 'method' ORDER BY file, start_line) AS n FROM spans)
SELECT a.name, coalesce(e.path, t.path) AS path, coalesce(e.line, t.line, -1)::INTEGER AS line, CASE WHEN e.path IS NOT NULL THEN 'precise' WHEN t.path IS NOT NULL THEN 'heuristic' ELSE 'unavailable' END AS source
FROM asked a LEFT JOIN (SELECT * FROM first WHERE n = 1 AND kind <> 'method') e ON e.name = a.name LEFT JOIN (SELECT * FROM first WHERE n = 1 AND kind = 'method') t ON t.name = a.name""",
}
