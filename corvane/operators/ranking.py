"""Fusing evidence of several channels into one ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Channels whose scores are divided by one common maximum.
SHARED = {"lexical": "text", "witness": "text", "graph": "graph", "semantic": "semantic"}
PRIORITY = {"lexical": 4, "witness": 3, "graph": 2, "semantic": 1}


@dataclass(frozen=True)
class Weights:
    lexical: float = 0.5
    graph: float = 0.3
    semantic: float = 0.2
    #: Parts of the lexical weight where a witness speaks too.
    text_part: float = 0.7
    witness_part: float = 0.3


def _of_channel(values: dict, default) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col("channel") == k, F.lit(v)) if out is None else out.when(F.col("channel") == k, F.lit(v))
    return out.otherwise(F.lit(default))


def normalise(evidence: DataFrame) -> DataFrame:
    """Scores divided by the maximum of their group of channels, between 0 and 1: adds `score`. Null and negative scores count 0."""
    raw = F.greatest(F.coalesce("raw_score", F.lit(0.0)), F.lit(0.0))
    tops = evidence.groupBy(_of_channel(SHARED, "other").alias("grp")).agg(F.max(raw).alias("top"))
    # One row a group of channels.
    return evidence.withColumn("grp", _of_channel(SHARED, "other")).join(F.broadcast(tops), "grp").withColumn("score", F.when(F.col("top") > 0, raw / F.col("top")).otherwise(0.0)).drop("grp", "top")


def blend(scored: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """One row per document and line: the best score of each channel, their blend, sources, the excerpt of the channel that counts most."""
    best = lambda name: F.coalesce(F.max(F.when(F.col("channel") == name, F.col("score"))), F.lit(0.0)).alias(name)
    rows = scored.groupBy("document", "line").agg(
        *[best(c) for c in PRIORITY], F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("sources"),
        F.max(F.struct(_of_channel(PRIORITY, 0).alias("p"), F.size(F.split("excerpt", " ")).alias("n"), F.col("excerpt").alias("e"))).alias("x"),
    )
    text = F.when(F.col("witness") == 0, F.col("lexical")).otherwise(weights.text_part * F.col("lexical") + weights.witness_part * F.col("witness"))
    return rows.withColumn("blended", F.round(weights.lexical * text + weights.graph * F.col("graph") + weights.semantic * F.col("semantic"), 6)).withColumn("excerpt", F.col("x.e")).drop("x")


def ranked(blended: DataFrame) -> list[Column]:
    """The total order of anchors."""
    return [F.col("blended").desc(), F.col("lexical").desc(), F.col("witness").desc(), F.col("graph").desc(), F.col("semantic").desc(), F.col("document"), F.col("line")]


def roll_up(blended: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """One row per document: document, score, lexical, witness, graph, semantic, line and excerpt of its representative, anchors.

    In rank order each further anchor adds, channel by channel, to what is missing to 1, with weight 0.35 by its place, at
    least 0.05; the score blends the channels so reached. The representative is the anchor with text, path or graph evidence, then
    the most words of two letters or more, then the longest excerpt, then the strongest channel; of equal ones the first in rank.
    Anchors are numbered by a window and folded by products, so no document's anchors are gathered.
    """
    placed = blended.withColumn("n", F.row_number().over(Window.partitionBy("document").orderBy(*ranked(blended))) - 1)
    weight = F.when(F.col("n") == 0, 1.0).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.35), 0.35 / F.col("n"))))
    score = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    folded = lambda c: (1 - F.product(1 - weight * score(c))).alias(c)
    excerpt = F.coalesce("excerpt", F.lit(""))
    told = F.greatest("lexical", "witness", "graph") > 0
    tier = F.when(F.col("lexical") > 0, 4).when(F.col("witness") > 0, 3).when(F.col("graph") > 0, 2).when(F.col("semantic") > 0, 1).otherwise(0)
    priority = F.struct(told.cast("int").alias("a"), F.size(F.regexp_extract_all(excerpt, F.lit("[A-Za-z0-9]{2,}"), F.lit(0))).alias("b"), F.octet_length(excerpt).alias("c"), tier.alias("d"), F.greatest(F.round(score("lexical") * 1000), F.round(score("witness") * 1000), F.round(score("graph") * 1000)).alias("e"), (-F.col("n")).alias("f"))
    rows = placed.groupBy("document").agg(*[folded(c) for c in ("lexical", "witness", "graph", "semantic")], F.max_by(F.struct("line", excerpt.alias("excerpt")), priority).alias("r"), F.count(F.lit(1)).cast("int").alias("anchors"))
    text = F.when(F.col("witness") == 0, F.col("lexical")).otherwise(weights.text_part * F.col("lexical") + weights.witness_part * F.col("witness"))
    return rows.select("document", F.round(weights.lexical * text + weights.graph * F.col("graph") + weights.semantic * F.col("semantic"), 6).alias("score"), *[F.round(c, 6).alias(c) for c in ("lexical", "witness", "graph", "semantic")], "r.line", "r.excerpt", "anchors")


#: Scores from which text speaks strongly for a document, and up to which a path alone speaks weakly.
STRONG, WEAK = 0.6, 0.3


def guarded(documents: DataFrame, query: str, symbols: DataFrame | None = None) -> DataFrame:
    """`documents` (of `roll_up`) with what puts them in front, and reasons (at most three), in that order: an exact symbol, the query
    itself in the excerpt, strong text, a graph neighbour, more than a weak path; then score. `symbols` has document of exact symbols."""
    marked = documents.withColumn("exact_symbol", F.lit(False)) if symbols is None else documents.join(symbols.select("document").distinct().withColumn("exact_symbol", F.lit(True)), "document", "left").withColumn("exact_symbol", F.coalesce("exact_symbol", F.lit(False)))
    marks = {"exact_symbol": F.col("exact_symbol"), "exact_text": F.contains(F.lower("excerpt"), F.lit(query.lower())) & (F.col("lexical") > 0), "strong_text": F.col("lexical") >= STRONG, "graph": F.col("graph") > 0, "more_than_path": ~((F.col("lexical") == 0) & (F.col("graph") == 0) & (F.col("witness") < WEAK))}
    told = marked.withColumns({f"by_{n}": c for n, c in marks.items()})
    reasons = F.slice(F.array_compact(F.array(*[F.when(F.col(f"by_{n}"), n) for n in marks])), 1, 3)
    order = F.struct(*[F.col(f"by_{n}").cast("int").alias(n) for n in marks], "score", "lexical", "witness", "graph", "semantic")
    return told.select(*documents.columns, F.array_join(reasons, ",").alias("reasons"), order.alias("_order"))


@dataclass(frozen=True)
class Gates:
    """Which channels run for a query, and why not."""

    graph: bool
    semantic: bool
    lexical_factor: int
    notes: tuple[str, ...]


def gates(shape: str, lexical_documents: int, limit: int, exact: bool, has_vectors: bool) -> Gates:
    """A query that looks like code and is met exactly by enough documents needs no graph; where text meets less than half of what
    is wanted its limit is raised fourfold; without vectors, or for code met exactly, nothing is compared by meaning."""
    notes = []
    graph = not (shape == "code" and exact and lexical_documents >= limit)
    if not graph:
        notes.append("graph skipped: exact text is enough")
    factor = 4 if 2 * lexical_documents < limit else 1
    if factor > 1:
        notes.append("text widened: few documents")
    semantic = has_vectors and not (shape == "code" and exact)
    if not semantic:
        notes.append("semantic skipped: " + ("no vectors" if not has_vectors else "exact text"))
    return Gates(graph, semantic, factor, tuple(notes))


def channel_counts(evidence: DataFrame, final: DataFrame) -> DataFrame:
    """How many of the final documents each channel met, and how many it met in all: channel, documents, final."""
    met = evidence.where("raw_score > 0").select("channel", "document").distinct()
    return met.join(final.select("document", F.lit(1).alias("kept")), "document", "left").groupBy("channel").agg(F.count(F.lit(1)).alias("documents"), F.count("kept").alias("final"))


def bounded_pool(blended: DataFrame, limit: int) -> DataFrame:
    """The first `limit` anchors and a reserve of the best anchors of documents not yet among them; `reserve` tells which."""
    reserve = max(2, min(8, limit // 4))
    # A pool that is certain to hold both: the best anchor of the first documents and the first anchors.
    in_doc = Window.partitionBy("document").orderBy(*ranked(blended))
    firsts = blended.withColumn("_in", F.row_number().over(in_doc))
    base = blended.orderBy(*ranked(blended)).limit(limit)
    unseen = firsts.where("_in = 1").drop("_in").join(base.select("document").distinct(), "document", "left_anti").orderBy(*ranked(blended)).limit(reserve)
    return base.withColumn("reserve", F.lit(False)).unionByName(unseen.withColumn("reserve", F.lit(True)))


def diversify(pool: list[dict], limit: int, repeat: float = 0.35, novelty: float = 0.1) -> list[dict]:
    """A greedy choice from a bounded pool: each time the row with the best score, less `repeat` per chosen row of its group, more `novelty` for a new group.

    Rows have score, group and rank; of equal values the smaller rank comes first. Made for pools of at most a few hundred rows on the driver.
    """
    chosen: list[dict] = []
    seen: dict = {}
    rest = list(pool)
    while rest and len(chosen) < limit:
        best = max(rest, key=lambda r: (r["score"] - repeat * seen.get(r["group"], 0) + (0 if r["group"] in seen else novelty), -r["rank"]))
        rest.remove(best)
        chosen.append(best)
        seen[best["group"]] = seen.get(best["group"], 0) + 1
    return chosen


@dataclass(frozen=True)
class Rule:
    """A gate over named boolean columns and its effect; all of `all_of`, one of `any_of`, none of `none_of` must hold."""

    id: str
    factor: float = 1.0
    add: float = 0.0
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()

    def gate(self, flags: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name in self.all_of:
            out = out & flags[name]
        if self.any_of:
            some = F.lit(False)
            for name in self.any_of:
                some = some | flags[name]
            out = out & some
        for name in self.none_of:
            out = out & ~flags[name]
        return out


def apply_rules(base: Column, rules: list[Rule], flags: dict[str, Column]) -> tuple[Column, Column]:
    """(score, trace): the rules in order, each adding to or multiplying the score so far; trace lists the ids of those that fired."""
    score, fired = base, []
    for rule in rules:
        gate = F.coalesce(rule.gate(flags), F.lit(False))
        score = F.when(gate, score * rule.factor + rule.add).otherwise(score)
        fired.append(F.when(gate, rule.id))
    return score, F.array_compact(F.array(*fired)) if fired else F.array().cast("array<string>")
