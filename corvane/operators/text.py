"""Search in texts: lines, exact match positions, prefilters, caps and pages.

Lines are 1-based; columns are byte offsets in the UTF-8 line plus one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Private-use letters that mark matches inside a line; the same letters in the input are swapped for a third of equal length.
_OPEN, _CLOSE, _SWAP = "\ue000", "\ue001", "\ue002"


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per line: keys, line (from 1), body. One carriage return at the end is cut; the empty piece behind a last line feed is no line. Null texts have no lines."""
    pieces = F.split(F.col(text), "\n", -1)
    numbered = df.where(F.col(text).isNotNull()).select(*keys, F.size(pieces).alias("_n"), F.posexplode(pieces).alias("_pos", "_line"))
    return numbered.where((F.col("_line") != "") | (F.col("_pos") + 1 < F.col("_n"))).select(*keys, (F.col("_pos") + 1).alias("line"), F.regexp_replace("_line", "\r$", "").alias("body"))


#: Values that a fold gathers before it sets them aside, so that appending stays cheap in lines with very many matches.
_RUN = 256


def _running(parts: Column, kind: str, value: Callable[[Column, Column], Column], width: Callable[[Column], Column]) -> Column:
    """`value` of the width of all parts before and the part, for each part in turn: one pass that carries the sum."""
    empty = F.array().cast(f"array<{kind}>")
    state = F.struct(F.lit(0).alias("sum"), empty.alias("run"), F.array().cast(f"array<array<{kind}>>").alias("full"))

    def step(a: Column, p: Column) -> Column:
        done = F.size(a["run"]) >= _RUN
        run = F.array_append(F.when(done, empty).otherwise(a["run"]), value(a["sum"], p))
        return F.struct((a["sum"] + width(p)).alias("sum"), run.alias("run"), F.when(done, F.array_append(a["full"], a["run"])).otherwise(a["full"]).alias("full"))

    return F.aggregate(parts, state, step, lambda a: F.flatten(F.array_append(a["full"], a["run"])))


def literal_columns(body: Column, literal: str) -> Column:
    """Columns of all non-overlapping occurrences, left to right."""
    parts = F.split(body, re.escape(literal) if not re.search(r"\\E", literal) else literal, -1)
    size = len(literal.encode())
    # An occurrence begins where the part before it ends; the last part is followed by none.
    ends = _running(parts, "int", lambda sum_, p: sum_ + F.octet_length(p) + 1, lambda p: F.octet_length(p) + size)
    return F.slice(ends, F.lit(1), F.size(ends) - 1)


def literal_matches(df: DataFrame, keys: list[str], text: str, literal: str) -> DataFrame:
    """keys, line, column, excerpt of every occurrence of `literal`, case-sensitive.

    Texts without it are filtered before they are cut into lines, lines before positions are counted.
    """
    found = lines(df.where(F.contains(text, F.lit(literal))), keys, text).where(F.contains("body", F.lit(literal)))
    return found.select(*keys, "line", F.explode(literal_columns(F.col("body"), literal)).alias("column"), F.col("body").alias("excerpt"))


def regex_matches(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """keys, line, column, matched of every non-overlapping match of a pattern without groups of its own.

    Literals that every match must contain are tested first (`required_literals`).
    """
    check_pattern(pattern)
    for literal in required_literals(pattern):
        df = df.where(F.contains(text, F.lit(literal)))
    found = lines(df, keys, text).where(F.col("body").rlike(pattern))
    marked = F.regexp_replace(F.translate("body", _OPEN + _CLOSE, _SWAP * 2), f"({pattern})", f"{_OPEN}$1{_CLOSE}")
    plain = lambda p: F.octet_length(F.translate(p, _CLOSE, ""))
    spots = _running(F.split(marked, _OPEN, -1), "struct<column:int,matched:string>", lambda sum_, p: F.struct((sum_ + 1).alias("column"), F.substring_index(p, _CLOSE, 1).alias("matched")), plain)
    # What stands before the first match is none.
    spots = F.slice(spots, F.lit(2), F.greatest(F.size(spots) - 1, F.lit(0)))
    return found.select(*keys, "line", F.explode(spots).alias("m")).select(*keys, "line", "m.column", "m.matched")


def term_pattern(terms: list[str], most: int = 12) -> str:
    """A case-insensitive pattern for whole words. Boundaries are spelt out, so that letters of any script count."""
    return r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(re.escape(t) for t in terms[:most]) + r")([^\p{L}\p{N}_]|$)"


def cap_per_key(matches: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` matches of each key, the first in `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return matches.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def page_after(matches: DataFrame, order: list[str], cursor: tuple | None, most: int) -> DataFrame:
    """The first `most` matches at or behind `cursor`, and the next one, the only row with resume = true, whose position is the next cursor."""
    if cursor is not None:
        position = F.struct(*order)
        matches = matches.where(position >= F.struct(*[F.lit(c).alias(o) for c, o in zip(cursor, order)]))
    page = matches.orderBy(*order).limit(most + 1)
    w = Window.orderBy(*order)  # of at most most + 1 rows
    return page.withColumn("resume", F.row_number().over(w) > most)


def slice_lines(df: DataFrame, keys: list[str], text: str, first: int, last: int, max_bytes: int) -> DataFrame:
    """keys, content, bytes, lines: lines first..last joined by line feeds, whole lines up to `max_bytes`; bytes counts what was asked for."""
    pieces = F.split(F.col(text), "\n", -1)
    n = F.size(pieces) - F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)
    wanted = F.slice(F.transform(F.slice(pieces, 1, n), lambda p: F.regexp_replace(p, "\r$", "")), first, max(0, last - first + 1))
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def step(a, p):
        size = a["used"] + F.octet_length(p) + F.when(a["used"] > 0, 1).otherwise(0)
        fits = a["open"] & (size <= max_bytes)
        return F.struct(F.when(fits, F.concat(a["kept"], F.array(p))).otherwise(a["kept"]).alias("kept"), F.when(fits, size).otherwise(a["used"]).alias("used"), fits.alias("open"))

    kept = F.aggregate(wanted, state, step)["kept"]
    whole = F.array_join(wanted, "\n")
    return df.where(F.col(text).isNotNull() & (n >= first)).select(*keys, F.array_join(kept, "\n").alias("content"), F.octet_length(whole).alias("bytes"), F.size(wanted).alias("lines"))


def scrub_leading_comment(text: Column) -> Column:
    """A comment that opens a markdown text is blanked; its line feeds stay, so line numbers hold."""
    comment = F.regexp_extract(text, r"^(\s*<!--(?s:.*?)-->)", 1)
    return F.when(comment == "", text).otherwise(F.concat(F.regexp_replace(comment, r"[^\n]", ""), F.substring(text, F.length(comment) + 1, F.length(text))))


def merge_first_wins(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """The union of match sets of one shape, without repetition: of equal keys the row of the earlier set stays; `part` tells the set."""
    union = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        union = part if union is None else union.unionByName(part)
    w = Window.partitionBy(*keys).orderBy("part")
    return union.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


class PatternError(ValueError):
    """A pattern that is too large or uses what a linear-time engine lacks; `code` says which."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


#: What a pattern may have at most.
PATTERN_LIMITS = {"bytes": 512, "alternations": 32, "groups": 32, "quantifiers": 64}


def check_pattern(pattern: str) -> None:
    """Raise PatternError unless the pattern keeps `PATTERN_LIMITS` and has no look-around or back-reference. Signs in classes and escapes don't count."""
    if not pattern:
        raise PatternError("empty")
    if len(pattern.encode()) > PATTERN_LIMITS["bytes"]:
        raise PatternError("bytes")
    count = dict.fromkeys(PATTERN_LIMITS, 0)
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if not in_class and pattern[i + 1 : i + 2].isdigit() and pattern[i + 1] != "0":
                raise PatternError("back-reference")
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            if re.match(r"\(\?(?:[=!]|<[=!])", pattern[i:]):
                raise PatternError("look-around")
            count["groups"] += 1
        elif c == "|":
            count["alternations"] += 1
        elif c in "*+?{" and not (c == "?" and pattern[i - 1 : i] in ("(", "*", "+", "?", "}")):
            count["quantifiers"] += 1
        i += 1
    for what, n in count.items():
        if n > PATTERN_LIMITS[what]:
            raise PatternError(what)
    try:
        re.compile(re.sub(r"\\[pP]\{\w+\}", "x", pattern))
    except re.error as e:
        raise PatternError("syntax") from e


def required_literals(pattern: str) -> list[str]:
    """Literals that every match must contain; none where alternation, groups, flags or non-ASCII signs make it unsure."""
    if re.search(r"[|()]", re.sub(r"\\.", "", pattern)) or not pattern.isascii():
        return []
    out, run, i = [], "", 0
    while i < len(pattern):
        c, size = pattern[i], 1
        literal: str | None = c
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            literal, size = (nxt, 2) if nxt and not nxt.isalnum() else (None, 2)
            if nxt in ("p", "P") and pattern[i + 2 : i + 3] == "{":
                size = pattern.index("}", i) - i + 1
        elif c == "[":
            literal, size = None, pattern.index("]", i + 2) - i + 1
        elif c in ".^$":
            literal = None
        quantifier = re.match(r"(?:[*+?]|\{\d*,?\d*\})[?+]?", pattern[i + size :])
        if quantifier and literal is not None:
            if quantifier[0][0] == "+":
                out.append(run + literal)
            else:
                out.append(run)
            run = ""
        elif literal is None:
            out.append(run)
            run = ""
        else:
            run += literal
        i += size + (quantifier.end() if quantifier else 0)
    out.append(run)
    return list(dict.fromkeys(x for x in out if x))
