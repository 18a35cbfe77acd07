"""What excerpts and terms tell: equal terms in other spellings, alignment with a query, trimmed and chosen lines, names and ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short forms that count as their long ones.
ALIASES = {"cmd": "command", "pkg": "package"}
#: Characters of a trimmed excerpt, and from how many a name is an identifier by its length.
TRIMMED, LONG_NAME = 160, 16


def plain_term(term: Column) -> Column:
    """A term in lower case without a plural ending, short forms written out: terms that count as equal have the same."""
    low = F.lower(term)
    single = F.when(low.rlike("ies$") & (F.length(low) > 4), F.concat(F.regexp_replace(low, "ies$", ""), F.lit("y"))).when(low.rlike("(ss|sh|ch|x|z)es$"), F.regexp_replace(low, "es$", "")).when(low.rlike("[^s]s$") & (F.length(low) > 3), F.regexp_replace(low, "s$", "")).otherwise(low)
    out = single
    for short, long in ALIASES.items():
        out = F.when(single == short, long).otherwise(out)
    return out


def fuzzy_overlap(candidates: Column, terms: Column) -> Column:
    """How many of the candidates equal one of the terms, whatever number or short form."""
    known = F.transform(terms, plain_term)
    return F.size(F.filter(candidates, lambda c: F.array_contains(known, plain_term(c))))


def exact_identifier(excerpt: Column, terms: list[str]) -> Column:
    """Whether a long or compound name of the query stands in the excerpt."""
    names = [t for t in terms if "_" in t or len(t) >= LONG_NAME]
    return reduce(lambda a, b: a | b, [F.contains(F.lower(excerpt), F.lit(n.lower())) for n in names], F.lit(False))


def build_flow(excerpt: Column) -> Column:
    """Whether a line is a step of a build."""
    return F.lower(excerpt).rlike(r"\b(runs-on|uses:|run:|steps:|build|bundle|deploy|publish|release)\b")


def test_double(excerpt: Column) -> Column:
    return F.lower(excerpt).rlike(r"\b(mock|stub|fake|spy|dummy|double)s?\b")


def alignment(excerpt: Column, terms: list[str], wants_build: bool = False) -> Column:
    """A factor of a line's score: more for each query term in it (up to three), for an exact name, and by whether it is a build step where that is asked for."""
    overlap = F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(excerpt), F.lit("[a-z0-9_]+"), F.lit(0))), F.array(*[F.lit(t.lower()) for t in terms])))
    # Factors by number of terms, for an exact name, for and against build steps.
    base = F.when(overlap >= 3, 1.24).when(overlap == 2, 1.14).when(overlap == 1, 1.05).otherwise(1.0)
    named = F.when(exact_identifier(excerpt, terms), 1.18).otherwise(1.0)
    flow = F.when(build_flow(excerpt), 1.24).otherwise(0.72) if wants_build else F.lit(1.0)
    return base * named * flow


def lexical_score(frequency: Column, quality: Column, aligned: Column) -> Column:
    return F.sqrt(frequency) * quality * aligned


def anchor_score(excerpt: Column, path_terms: Column, terms: list[str]) -> Column:
    """How well a line stands for its file: 4 a query term, 2 a term of the path, 8 for an exact name."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(excerpt), F.lit("[a-z0-9_]+"), F.lit(0)))
    asked = F.array(*[F.lit(t.lower()) for t in terms])
    return F.size(F.array_intersect(words, asked)) * 4 + F.size(F.array_intersect(words, path_terms)) * 2 + F.when(exact_identifier(excerpt, terms), 8).otherwise(0)


def trimmed(excerpt: Column) -> Column:
    bare = F.trim(excerpt)
    return F.when(F.length(bare) > TRIMMED, F.concat(F.substring(bare, 1, TRIMMED), F.lit("..."))).otherwise(bare)


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))


def stem_factor(stem: Column, asked: Column) -> Column:
    """1.65 where a file's stem is the one asked for, 0.78 where it only begins with it and a mark, else 1."""
    low, want = F.lower(stem), F.lower(asked)
    return F.when(low == want, 1.65).when(low.startswith(F.concat(want, F.lit("_"))) | low.startswith(F.concat(want, F.lit("-"))) | low.startswith(F.concat(want, F.lit("."))), 0.78).otherwise(1.0)


def index_identifier(symbol: Column) -> Column:
    """The name a code index's symbol ends with: what follows the last of # / . : $, without quotes, brackets and type parameters."""
    bare = F.regexp_replace(F.regexp_replace(symbol, r"\([^()]*\)|<[^<>]*>", ""), r"[`'\"]", "")
    return F.regexp_extract(F.regexp_replace(bare, r"[#/.:$]+$", ""), r"([^#/.:$]*)$", 1)


def snake_case(kind: Column) -> Column:
    return F.lower(F.regexp_replace(kind, r"([a-z0-9])([A-Z])", "$1_$2"))


def slug(name: Column) -> Column:
    """Letters and digits in lower case, all else as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def repository_key(root: Column, name: Column) -> Column:
    """A stable id of a repository: its slug and some of the hash of where it lies."""
    return F.concat(F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("repository")), F.lit("-"), F.substring(F.sha2(F.coalesce(root, F.lit("")), 256), 1, 12))


def record_id(*parts: Column) -> Column:
    """An id of the parts in order; null parts differ from empty ones."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("\1")) for p in parts]), 256), 1, 32)
