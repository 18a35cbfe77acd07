"""Navigation over a code index: symbols by name or place, definitions, implementations, relations told by declarations.

An index has `occurrences` (path, symbol, start_line, start_column, end_line, end_column, is_definition), `symbols` (path, symbol,
display_name, kind) and `relationships` (path, from_symbol, to_symbol, kind), as `graph.index_records` gives it of an index
that a compiler wrote; `text_index` makes one of texts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.joins import lookup_join
from corvane.operators.surfaces import with_facts
from corvane.operators.symbols import WORD

#: What a declaration line says it is derived from: a base, an interface, a trait.
HERITAGE = (("extends", r"\bextends\s+([A-Za-z_][A-Za-z0-9_]*)"), ("implements", r"\bimplements\s+([A-Za-z_][A-Za-z0-9_]*)"), ("extends", r"^\s*class\s+[A-Za-z_][A-Za-z0-9_]*\s*\(\s*([A-Za-z_][A-Za-z0-9_]*)"), ("implements", r"^\s*(?:unsafe\s+)?impl(?:\s*<[^>]*>)?\s+([A-Za-z_][A-Za-z0-9_]*)[^{]*\bfor\s"))


def identifier(symbol: Column) -> Column:
    """The last name in a symbol's spelling, whatever signs end it. It is read from the end, as a search for it would try every letter of every name before."""
    return F.reverse(F.regexp_extract(F.reverse(symbol), r"^[^A-Za-z0-9_]*([A-Za-z0-9_]+)", 1))


def symbol_name(path: Column, canonical: Column, line: Column) -> Column:
    """The spelling of a symbol told by a text."""
    return F.concat(F.lit("text "), path, F.lit("#"), canonical, F.lit("@"), line, F.lit("."))


def text_index(code: DataFrame, spans: DataFrame) -> dict[str, DataFrame]:
    """An index of declarations and of lines that hold their names; a name counts for the declaration in its own file, the last of
    several, else for the only one there is elsewhere. Columns are those of the first place of the name in the line."""
    named = spans.select(F.col("file").alias("path"), symbol_name(F.col("file"), F.col("canonical"), F.col("start_line")).alias("symbol"), F.col("name").alias("display_name"), "kind", "start_line")
    lines = code.withColumnRenamed("file", "path")
    column = F.instr(F.col("body"), F.col("display_name"))

    def placed(rows: DataFrame, definition: bool) -> DataFrame:
        return rows.select("path", "symbol", F.col("line").alias("start_line"), column.alias("start_column"), F.col("line").alias("end_line"), (column + F.length("display_name")).alias("end_column"), F.lit(definition).alias("is_definition"))

    defined = named.join(lines.select("path", F.col("line").alias("start_line"), "body"), ["path", "start_line"]).withColumnRenamed("start_line", "line")
    words = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(WORD), F.lit(1)), lambda w: F.rtrim(w, F.lit("("))))
    used = lines.select("path", "line", "body", F.explode(words).alias("display_name")).join(named.select("path", F.col("start_line").alias("line"), "display_name"), ["path", "line", "display_name"], "left_anti")
    here = named.groupBy("path", "display_name").agg(F.max_by("symbol", "start_line").alias("own"))
    only = named.groupBy("display_name").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("other")).where("n = 1").select("display_name", "other")
    met = used.join(here, ["path", "display_name"], "left")
    met = lookup_join(met, only, ["display_name"], "left", salt_on=["path", "line"]).withColumn("symbol", F.coalesce("own", "other")).where("symbol is not null")
    return {"symbols": named.drop("start_line"), "occurrences": placed(defined, True).unionByName(placed(met, False))}


def name_rank(symbols: DataFrame, query: str, fallback: str | None = None) -> DataFrame:
    """Symbols that answer a query, with rank: 0 the symbol itself, 1 and 2 its display name and last name, 3 and 4 these whatever case, 5 to 8 likewise for the fallback name."""
    told = with_facts(symbols, _tail=F.coalesce(F.nullif(identifier(F.col("symbol")), F.lit("")), F.col("symbol")))
    shown, tail = F.col("display_name"), F.col("_tail")
    rank = F.when(F.col("symbol") == query, 0)
    for i, name in enumerate((query, fallback or query)):
        low = name.lower()
        rank = rank.when(shown == name, 4 * i + 1).when(tail == name, 4 * i + 2).when(F.lower(shown) == low, 4 * i + 3).when(F.lower(tail) == low, 4 * i + 4)
    return told.withColumn("rank", rank).where("rank is not null").drop("_tail")


def symbol_at(occurrences: DataFrame, symbols: DataFrame, places: DataFrame) -> DataFrame:
    """The symbol at or before each place: the columns of `places` (path, line, column, which may be null) with symbol and contained.

    Of the occurrences that begin at or before it those that contain the place come first, then the nearest in lines, then in
    columns, then the later start, then the lesser symbol. Places are looked up; occurrences are read once and folded to one row a place.
    """
    asked = places.select("path", "line", "column").distinct()
    known = occurrences.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    met = lookup_join(known, asked, ["path"], salt_on=["symbol", "start_line"]).where("start_line <= line and (column is null or start_line < line or start_column <= column)")
    at_line = F.col("line") == F.col("start_line")
    ends = (F.col("end_line") > F.col("line")) | ((F.col("end_line") == F.col("line")) & (F.col("column").isNull() | (F.col("column") < F.col("end_column")) | (F.col("end_line") > F.col("start_line")) & (F.col("column") <= F.col("end_column"))))
    far = F.when(at_line & F.col("column").isNotNull(), F.col("column") - F.col("start_column")).otherwise(0)
    order = F.struct((~ends).cast("int").alias("outside"), (F.col("line") - F.col("start_line")).alias("lines"), far.alias("columns"), (-F.col("start_line")).alias("a"), (-F.col("start_column")).alias("b"), "symbol")
    best = met.groupBy("path", "line", "column").agg(F.min(order).alias("o")).select("path", "line", F.col("column").alias("_column"), "o.symbol", (F.col("o.outside") == 0).alias("contained"))
    left, right = places.alias("p"), best.alias("b")
    same = (F.col("p.path") == F.col("b.path")) & (F.col("p.line") == F.col("b.line")) & F.col("p.column").eqNullSafe(F.col("b._column"))
    return left.join(right, same, "left").select("p.*", "b.symbol", F.coalesce("b.contained", F.lit(False)).alias("contained"))


def definitions(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each symbol with the first of its definitions: symbol, display_name, kind, path, start_line, start_column."""
    first = occurrences.where("is_definition").groupBy("symbol").agg(F.min(F.struct("path", "start_line", "start_column")).alias("d"))
    shown = symbols.groupBy("symbol").agg(F.min(F.struct("display_name", "kind")).alias("s"))
    return first.join(shown, "symbol").select("symbol", "s.*", "d.*")


def definitions_of_uses(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every use with where its symbol is defined: path, start_line, start_column, symbol, display_name, defined_in, defined_at, same_file."""
    where = definitions(occurrences, symbols).select("symbol", "display_name", F.col("path").alias("defined_in"), F.col("start_line").alias("defined_at"))
    return occurrences.where("not is_definition").join(where, "symbol").select("path", "start_line", "start_column", "symbol", "display_name", "defined_in", "defined_at", (F.col("path") == F.col("defined_in")).alias("same_file"))


def go_to_definition(precise: DataFrame, heuristic: DataFrame, queries: DataFrame) -> DataFrame:
    """Where names are defined, by the first source that knows: queries (name) with path, line (-1 where unknown), source (precise, heuristic or unavailable).

    precise: `definitions` of an index; heuristic: `symbols` of texts. Of several the least path and line counts.
    """
    exact = precise.groupBy(F.col("display_name").alias("name")).agg(F.min(F.struct("path", F.col("start_line").alias("line"))).alias("exact"))
    told = heuristic.groupBy("name").agg(F.min(F.struct(F.col("file").alias("path"), F.col("start_line").alias("line"))).alias("told"))
    met = queries.select("name").distinct().join(exact, "name", "left").join(told, "name", "left")
    best = F.coalesce("exact", "told")
    source = F.when(F.col("exact").isNotNull(), "precise").when(F.col("told").isNotNull(), "heuristic").otherwise("unavailable")
    return met.select("name", best["path"].alias("path"), F.coalesce(best["line"], F.lit(-1)).alias("line"), source.alias("source"))


def implementations(relationships: DataFrame, symbols: DataFrame, occurrences: DataFrame, kinds: tuple[str, ...] = ("implementation", "type_definition", "implements", "extends")) -> DataFrame:
    """What implements or extends each symbol: to_symbol, kind, symbol, display_name, path, start_line."""
    told = definitions(occurrences, symbols).select("symbol", "display_name", "path", "start_line")
    return relationships.where(F.col("kind").isin(*kinds)).select("to_symbol", F.col("kind"), F.col("from_symbol").alias("symbol")).distinct().join(told, "symbol").select("to_symbol", "kind", "symbol", "display_name", "path", "start_line")


def heritage(code: DataFrame, spans: DataFrame) -> DataFrame:
    """Edges from a declaration to what its line says it extends or implements: file, name, start_line, base, kind."""
    head = code.join(spans.select("file", "name", F.col("start_line").alias("line")), ["file", "line"])
    edges = F.array_compact(F.array(*[F.when(F.regexp_extract("body", p, 1) != "", F.struct(F.regexp_extract("body", p, 1).alias("base"), F.lit(k).alias("kind"))) for k, p in HERITAGE]))
    return head.select("file", "name", F.col("line").alias("start_line"), F.explode(edges).alias("e")).select("file", "name", "start_line", "e.*").distinct()


def nearest_references(references: DataFrame, most: int) -> DataFrame:
    """At most `most` uses of each symbol, those in the file of its definition first, then in order."""
    w = Window.partitionBy("symbol").orderBy(F.col("same_file").desc(), "path", "start_line", "start_column")
    return references.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
