"""Property graphs of symbols, and records of a code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.joins import lookup_join
from corvane.session import materialise, materialise_as

# How far a relation can be trusted, and the weight it has in the graph channel.
CONFIDENCE = {"calls": "high", "refers_to": "high", "implements": "high", "extends": "high", "contains": "medium", "defined_in": "low"}
WEIGHTS = {"calls": 1.0, "refers_to": 0.9, "implements": 0.95, "extends": 0.9, "contains": 0.6, "defined_in": 0.5}


def edge_set(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges once each, edges with an unknown end): src, dst, kind. Null ends are unknown."""
    once = edges.select("src", "dst", "kind").distinct()
    ids = materialise(nodes.select("id").where("id is not null").distinct())
    flagged = once
    for end, other in (("src", "dst"), ("dst", "src")):
        side = materialise_as(ids, ids.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_known")))
        flagged = lookup_join(flagged, side, [end], "left", salt_on=[other, "kind"])
    both = F.col("src_known").isNotNull() & F.col("dst_known").isNotNull()
    return flagged.where(both).select("src", "dst", "kind"), flagged.where(~both).select("src", "dst", "kind")


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions: id, neighbour, kind, direction."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "kind", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "kind", F.lit("in").alias("direction")))


def relation_hints(edges: DataFrame) -> DataFrame:
    """Edges with the confidence of their kind; kinds that are not listed have none."""
    return edges.withColumn("confidence", _by_kind(CONFIDENCE))


def _by_kind(values: dict) -> F.Column:
    out = None
    for kind, value in values.items():
        out = F.when(F.col("kind") == kind, F.lit(value)) if out is None else out.when(F.col("kind") == kind, F.lit(value))
    return out


def graph_hits(seeds: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """Neighbours of seeds by product of weights: id, score, seeds. A step against an edge counts 0.95; each seed hands on its best `most`.

    seeds: id, weight. A neighbour's score is the best product; seeds counts what led to it.
    """
    steps = adjacency(edges).withColumn("w", F.coalesce(_by_kind(WEIGHTS), F.lit(0.5)) * F.when(F.col("direction") == "out", 1.0).otherwise(0.95))
    reached = seeds.select(F.col("id"), F.col("weight").alias("seed_weight")).join(steps, "id").groupBy("id", "neighbour").agg(F.max(F.col("seed_weight") * F.col("w")).alias("score"))
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "neighbour")
    kept = reached.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return kept.groupBy(F.col("neighbour").alias("id")).agg(F.round(F.max("score"), 6).alias("score"), F.count(F.lit(1)).alias("seeds"))


#: The documents of a code index in JSON.
INDEX_SCHEMA = (
    "documents array<struct<relative_path:string,occurrences:array<struct<symbol:string,range:array<int>,symbol_roles:int>>,"
    "symbols:array<struct<symbol:string,display_name:string,kind:string,relationships:array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean>>>>>>"
)


def index_records(index: DataFrame) -> dict[str, DataFrame]:
    """Occurrences, symbols, relationships and problems of index files read with INDEX_SCHEMA.

    Ranges of three numbers lie in one line; all numbers become 1-based. Rows that break a rule go to
    problems (code, path, symbol) and nowhere else: missing path or symbol, a range of another length, an
    end before its start, a relationship without a kind. Repeated records count once.
    """
    docs = index.select(F.explode("documents").alias("d")).select("d.*")
    pathless = F.coalesce(F.trim("relative_path"), F.lit("")) == ""
    occ = docs.select("relative_path", pathless.alias("p"), F.explode("occurrences").alias("o")).select("relative_path", "p", "o.*")
    n = F.size("range")
    at = lambda i: F.get("range", F.lit(i)) + 1
    spans = occ.withColumn("start_line", at(0)).withColumn("start_column", at(1)).withColumn("end_line", F.when(n == 3, at(0)).otherwise(at(2))).withColumn("end_column", F.when(n == 3, at(2)).otherwise(at(3)))
    no_symbol = F.coalesce(F.col("symbol"), F.lit("")) == ""
    code = F.when(F.col("p"), "missing_path").when(no_symbol, "missing_symbol").when(F.col("range").isNull() | ~n.isin(3, 4), "range_length").when((F.col("end_line") < F.col("start_line")) | ((F.col("end_line") == F.col("start_line")) & (F.col("end_column") < F.col("start_column"))), "range_order")
    spans = spans.withColumn("code", code)
    sym = docs.select("relative_path", pathless.alias("p"), F.explode("symbols").alias("s")).select("relative_path", "p", "s.*").withColumn("code", F.when(F.col("p"), "missing_path").when(no_symbol, "missing_symbol"))
    rel = sym.where("code is null").select("relative_path", F.col("symbol").alias("from_symbol"), F.explode("relationships").alias("r")).select("relative_path", "from_symbol", F.col("r.symbol").alias("symbol"), "r.is_reference", "r.is_implementation", "r.is_type_definition", "r.is_definition")
    flags = ("is_reference", "is_implementation", "is_type_definition", "is_definition")
    rel = rel.withColumn("code", F.when(no_symbol, "missing_symbol").when(~F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in flags]), "relationship_kind"))
    bad = lambda df: df.where("code is not null").select("code", F.col("relative_path").alias("path"), "symbol")
    path = F.col("relative_path").alias("path")
    return {
        "occurrences": spans.where("code is null").select(path, "symbol", "start_line", "start_column", "end_line", "end_column", (F.coalesce("symbol_roles", F.lit(0)).bitwiseAND(1) == 1).alias("is_definition")).distinct(),
        "symbols": sym.where("code is null").select(path, "symbol", "display_name", "kind").distinct(),
        "relationships": rel.where("code is null").select(path, "from_symbol", F.col("symbol").alias("to_symbol"), F.explode(F.array_compact(F.array(*[F.when(F.col(f), f[3:]) for f in flags]))).alias("kind")).distinct(),
        "problems": bad(spans).unionByName(bad(sym)).unionByName(bad(rel)),
    }


def definitions(occurrences: DataFrame) -> DataFrame:
    """The first definition of each symbol: symbol, path, start_line, start_column."""
    return occurrences.where("is_definition").groupBy("symbol").agg(F.min(F.struct("path", "start_line", "start_column")).alias("d")).select("symbol", "d.*")


def symbol_references(occurrences: DataFrame) -> DataFrame:
    """Occurrences that are no definitions, with where their symbol is defined."""
    where = definitions(occurrences).select("symbol", F.col("path").alias("defined_in"), F.col("start_line").alias("defined_at"))
    return occurrences.where("not is_definition").join(where, "symbol", "left")


def replace_files(stored: DataFrame, incoming: DataFrame, overlay: bool = False) -> DataFrame:
    """Records after a new index: `overlay` adds to what a file has, otherwise the file's records are replaced."""
    if overlay:
        return stored.unionByName(incoming).distinct()
    return stored.join(incoming.select("path").distinct(), "path", "left_anti").unionByName(incoming).select(*stored.columns).distinct()
