"""Symbols of source files, how they nest, their references and calls.

Declarations are told by their first line and their indentation, without a grammar: an approximation that is stated in
the README (`functions.outline`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.outline import DECLARATION, METHOD, outline
from corvane.operators.text import lines

#: A word and the bracket behind it. Words are taken whole, so long runs of letters cost one pass.
WORD = r"([A-Za-z0-9_]+[(]?)"
# Words with a bracket behind them that call nothing.
NO_CALLS = ("if", "for", "while", "switch", "return", "catch", "match", "elif", "elseif", "when", "until", "with", "and", "or", "not", "in", "is", "function", "fn", "func", "fun", "def", "sizeof", "typeof", "await", "yield", "except", "assert", "foreach", "unless", "super", "self")
#: A line that is a comment as a whole.
COMMENT = r"^\s*(?://|#|--|/?\*|;)"

CHAIN = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))
SCHEMA = "file string, kind string, name string, start_line int, end_line int, around array<struct<name:string,kind:string,start_line:int,end_line:int>>"


def source_texts(contents: DataFrame) -> DataFrame:
    """file, path, text: every distinct text (repeated rows of a digest count once)."""
    least = F.min(F.struct(F.coalesce("path", F.lit("")).alias("path"), F.col("content_text").alias("text"))).alias("r")
    return contents.where("sha256 is not null and content_text is not null").groupBy(F.lower("sha256").alias("file")).agg(least).select("file", "r.path", "r.text")


def source_lines(texts: DataFrame) -> DataFrame:
    """file, line, body: every line of `source_texts`."""
    return lines(texts, ["file"], "text")


def symbols(texts: DataFrame) -> DataFrame:
    """file, kind, name, start_line, end_line, container (the innermost declaration around, or null), depth, canonical (names from the outermost in, joined by dots), around (those declarations) of `texts` (file, text). Null texts have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                for row in outline(text.as_py() or ""):
                    at.append(i)
                    rows.append(row)
            kind, name, start, end, around = zip(*rows) if rows else ((), (), (), (), ())
            chains = pa.array([[{"name": n, "kind": k, "start_line": a, "end_line": b} for n, k, a, b in c] for c in around], CHAIN)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(name, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), chains], names=["file", "kind", "name", "start_line", "end_line", "around"])

    found = texts.select(F.col("file").cast("string").alias("file"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, SCHEMA)
    names = F.transform("around", lambda c: c["name"])
    return found.select("file", "kind", "name", "start_line", "end_line", F.try_element_at(names, F.lit(-1)).alias("container"), F.size("around").alias("depth"), F.array_join(F.concat(names, F.array("name")), ".").alias("canonical"), "around")


def outline_rows(spans: DataFrame) -> DataFrame:
    """The symbol tree of each file: file, place (from 1 in line order), parent_place (0 at the top), depth, kind, name, start_line, end_line."""
    w = Window.partitionBy("file").orderBy("start_line")
    placed = spans.withColumn("place", F.row_number().over(w))
    parents = placed.select("file", F.col("start_line").alias("parent_start"), F.col("place").alias("parent_place"))
    asked = placed.withColumn("parent_start", F.try_element_at(F.transform("around", lambda c: c["start_line"]), F.lit(-1)))
    return asked.join(parents, ["file", "parent_start"], "left").select("file", "place", F.coalesce("parent_place", F.lit(0)).alias("parent_place"), "depth", "kind", "name", "start_line", "end_line")


def _carried(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits with the last declaration at or before their line (`at`): both are merged in line order and it is carried forward, one sort instead of a range join."""
    kind = spans.select(F.struct("start_line", "end_line", "name", "kind", "around").alias("s")).schema["s"].dataType
    marks = spans.select("file", F.col("start_line").alias("line"), F.lit(0).alias("side"), F.struct("start_line", "end_line", "name", "kind", "around").alias("s"))
    asked = hits.select("file", "line").distinct().select("file", "line", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("s"))
    w = Window.partitionBy("file").orderBy("line", "side").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asked).withColumn("at", F.last("s", ignorenulls=True).over(w)).where("side = 1").select("file", "line", "at")


def _open(kinds: tuple[str, ...] = ()) -> Column:
    """Of what `_carried` gives the innermost span that has not ended before the line."""
    own = F.array(F.struct(*[F.col("at." + c).alias(c) for c in ("name", "kind", "start_line", "end_line")]))
    still = F.filter(F.concat("at.around", own), lambda c: (c["end_line"] >= F.col("line")) & (c["kind"].isin(*kinds) if kinds else F.lit(True)))
    return F.try_element_at(still, F.lit(-1))


def enclosing_symbol(hits: DataFrame, spans: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The innermost span, of some kinds or any, of the same file around each line: the columns of `hits` with name and kind, null outside all such spans.

    Spans nest, so it is the last that began, or the innermost of those around it that has not ended.
    """
    best = _carried(hits, spans).select("file", "line", _open(kinds).alias("s")).select("file", "line", "s.name", "s.kind")
    return hits.join(best, ["file", "line"], "left")


def symbol_at_or_before(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """As-of join: the innermost declaration around each line or, outside all, the last before it: columns of `hits`, name, distance from its first line (-1 where there is none), inside."""
    told = _carried(hits, spans).select("file", "line", _open().alias("inner"), "at")
    first = F.coalesce("inner.start_line", "at.start_line")
    return hits.join(told.select("file", "line", F.coalesce("inner.name", "at.name").alias("name"), F.coalesce(F.col("line") - first, F.lit(-1)).alias("distance"), F.col("inner").isNotNull().alias("inside")), ["file", "line"], "left")


def symbol_rank(spans: DataFrame, query: str) -> DataFrame:
    """Symbols that match a name: file, name, canonical, kind, start_line, rank. Ranks: 0 to 2 the canonical name (exact, whatever case, prefix), 3 to 5 the name likewise, 6 inside the name."""
    low, canonical, name = query.lower(), F.col("canonical"), F.col("name")
    nested = F.col("depth") > 0
    rank = (
        F.when(nested & (canonical == query), 0).when(nested & (F.lower(canonical) == low), 1).when(nested & F.lower(canonical).startswith(low), 2)
        .when(name == query, 3).when(F.lower(name) == low, 4).when(F.lower(name).startswith(low), 5).when(F.contains(F.lower(name), F.lit(low)), 6)
    )
    return spans.withColumn("rank", rank).where("rank is not null").select("file", "name", "canonical", "kind", "start_line", "rank")


def search_symbols(spans: DataFrame, query: str, limit: int) -> DataFrame:
    """The first `limit` of `symbol_rank`; names that only hold the query inside come in only where the others leave room, as they rank behind them."""
    return symbol_rank(spans, query).orderBy("rank", "file", "start_line", "kind", "name").limit(limit)


def declares(body: Column) -> Column:
    return body.rlike(DECLARATION) | body.rlike(METHOD)


def calls(code: DataFrame, spans: DataFrame, declared_only: bool = False) -> DataFrame:
    """Call edges: file, caller, callee, calls; callee is a name with a bracket behind it in the caller's body, of a function declared anywhere if `declared_only`. Comments, texts in quotes and words of the language call nothing."""
    kinds = ("function", "method")
    functions = spans.where(F.col("kind").isin(*kinds))
    bare = F.regexp_replace("body", r"\"[^\"]*\"|'[^']*'", "")
    words = F.filter(F.regexp_extract_all(bare, F.lit(WORD), F.lit(1)), lambda w: w.endswith("(") & ~F.substring(w, 1, 1).between("0", "9"))
    used = code.where(F.contains("body", F.lit("(")) & ~declares(F.col("body")) & ~F.col("body").rlike(COMMENT)).select("file", "line", F.explode(words).alias("w")).select("file", "line", F.rtrim("w", F.lit("(")).alias("callee")).where(~F.col("callee").isin(*NO_CALLS))
    known = used.join(functions.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi") if declared_only else used
    placed = enclosing_symbol(known, spans, kinds)
    return placed.where("name is not null").groupBy("file", F.col("name").alias("caller"), "callee").agg(F.count(F.lit(1)).alias("calls"))


def references(code: DataFrame, spans: DataFrame) -> DataFrame:
    """How often each declared name stands as a whole word outside its declarations: name, references, files."""
    names = spans.select("name").distinct()
    words = code.select("file", "line", F.explode(F.regexp_extract_all("body", F.lit(WORD), F.lit(1))).alias("w")).select("file", "line", F.rtrim("w", F.lit("(")).alias("name"))
    declared = spans.select("file", F.col("start_line").alias("line"), "name")
    return words.join(names, "name", "left_semi").join(declared, ["file", "line", "name"], "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("references"), F.countDistinct("file").alias("files"))
