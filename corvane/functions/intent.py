"""What a search query asks for, told from its words; limits that follow from it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Words that tell of an intent.
INTENTS = {
    "docs": {"docs", "documentation", "guide", "readme", "manual", "tutorial", "explain"},
    "readme": {"readme"},
    "onboarding": {"onboarding", "setup", "install", "getting", "started", "quickstart"},
    "contracts": {"contract", "contracts", "schema", "api", "interface", "spec"},
    "errors": {"error", "errors", "failure", "failures", "exception", "taxonomy"},
    "tests": {"test", "tests", "testing", "spec", "regression", "assert"},
    "fixtures": {"fixture", "fixtures", "sample", "samples"},
    "benchmarks": {"benchmark", "benchmarks", "bench", "performance", "throughput"},
    "examples": {"example", "examples", "demo"},
    "runtime": {"runtime", "handler", "handled", "implementation", "implemented", "server", "service", "where"},
    "config": {"config", "configuration", "settings", "manifest", "cargo", "package", "env"},
    "entrypoint": {"entrypoint", "main", "bootstrap", "startup", "cli", "command", "build", "workflow"},
    "ci": {"ci", "workflow", "workflows", "pipeline", "release", "deploy"},
    "navigation": {"navigation", "route", "routes", "router", "definition", "reference", "references"},
}
# Words that carry no meaning of their own.
STOP = frozenset("a an and are as at be by does for from how in is it its of on or that the this to what when where which who why with".split())


@dataclass(frozen=True)
class Intent:
    """flags by name; terms as `exact_terms` gives them; shape is code, language or neutral."""

    flags: frozenset[str]
    terms: tuple[str, ...]
    shape: str
    lexical_limit: int
    pool_limit: int
    notes: tuple[str, ...] = field(default=())


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def exact_terms(query: str, least: int = 4) -> list[str]:
    """Words of letters, digits and underscores in lower case, at least `least` long, without stop words, in the order they first come."""
    words = re.findall(r"[A-Za-z0-9_]+", query)
    return list(dict.fromkeys(w for w in map(ascii_lower, words) if len(w) >= least and w not in STOP))


def overlap_terms(query: str) -> list[str]:
    """As exact_terms from 2 letters on, with the parts of compound and camel-case names."""
    out: dict[str, None] = {}
    for word in re.findall(r"[A-Za-z0-9_\-]+", query):
        for part in [word, *re.split(r"[_\-]+", word), *re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", word)]:
            low = ascii_lower(part.strip("_-"))
            if len(low) >= 2 and low not in STOP:
                out[low] = None
    return list(out)


def query_shape(query: str) -> str:
    """code for names, paths and calls; language for several plain words; else neutral."""
    if re.search(r"[_/(){};<>]|::|->|\w\.\w|[a-z][A-Z]", query):
        return "code"
    return "language" if len(re.findall(r"[A-Za-z]+", query)) >= 4 else "neutral"


def limits(limit: int, shape: str, most: int = 200) -> tuple[int, int]:
    """(lexical matches, ranked pool) to look at for `limit` results."""
    limit = max(1, min(limit, most))
    lexical = {"code": max(limit + 2, 8), "neutral": max(2 * limit, 16), "language": max(6 * limit, 30)}[shape]
    return min(lexical, max(most, limit)), max(32, 4 * limit)


def read_query(query: str, limit: int = 16) -> Intent:
    words = set(re.findall(r"[a-z0-9]+", ascii_lower(query)))
    flags = frozenset(name for name, told in INTENTS.items() if words & told)
    shape = query_shape(query)
    return Intent(flags, tuple(exact_terms(query)), shape, *limits(limit, shape))
