"""Graph queries, over orders as nodes that refer to parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import graph as op
from corvane.tables import load


def _nodes(spark, folder):
    part = load(spark, folder, "part").select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"))
    supplier = load(spark, folder, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("id"))
    orders = load(spark, folder, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("id"))
    return part.unionByName(supplier).unionByName(orders)


def _edges(spark, folder):
    item = load(spark, folder, "lineitem")
    order, part, supplier = F.concat(F.lit("order:"), F.col("l_orderkey")), F.concat(F.lit("part:"), F.col("l_partkey")), F.concat(F.lit("supplier:"), F.col("l_suppkey"))
    kind = F.when(F.col("l_returnflag") == "R", "refers_to").otherwise("calls")
    return item.select(order.alias("src"), part.alias("dst"), kind.alias("kind")).unionByName(item.select(part.alias("src"), supplier.alias("dst"), F.lit("defined_in").alias("kind")))


def graph_edges_dedup(spark, folder):
    return op.edge_set(_edges(spark, folder), _nodes(spark, folder))[0]


def graph_unknown_ends(spark, folder):
    return op.edge_set(_edges(spark, folder), _nodes(spark, folder))[1].groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


def graph_adjacency(spark, folder):
    known = graph_edges_dedup(spark, folder)
    return op.adjacency(known).groupBy("id", "direction", "kind").agg(F.count(F.lit(1)).alias("degree"), F.min("neighbour").alias("first_neighbour"))


def graph_relation_hints(spark, folder):
    return op.relation_hints(graph_edges_dedup(spark, folder)).groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("edges"))


def projected_graph_hits(spark, folder):
    """Seeds are all parts of one brand, weighted by size."""
    seeds = load(spark, folder, "part").where("p_brand = 'Brand#11'").select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"), (F.lit(1.0) / (F.col("p_size") + 1)).alias("weight"))
    return op.graph_hits(seeds, graph_edges_dedup(spark, folder))


QUERIES = {f.__name__: f for f in (graph_edges_dedup, graph_unknown_ends, graph_adjacency, graph_relation_hints, projected_graph_hits)}

_KNOWN = """nodes AS (SELECT 'part:' || p_partkey AS id FROM part UNION SELECT 'supplier:' || s_suppkey FROM supplier UNION SELECT 'order:' || o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
once AS (SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'refers_to' ELSE 'calls' END AS kind FROM lineitem UNION SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'defined_in' FROM lineitem),
known AS (SELECT * FROM once WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
adjacent AS (SELECT src AS id, dst AS neighbour, kind, 'out' AS direction FROM known UNION ALL SELECT dst, src, kind, 'in' FROM known)"""
_CASE = lambda values: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"
SQL = {
    "graph_edges_dedup": f"WITH {_KNOWN} SELECT * FROM known",
    "graph_unknown_ends": f"WITH {_KNOWN} SELECT kind, count(*) AS edges FROM (SELECT * FROM once EXCEPT SELECT * FROM known) GROUP BY 1",
    "graph_adjacency": f"WITH {_KNOWN} SELECT id, direction, kind, count(*) AS degree, min(neighbour) AS first_neighbour FROM adjacent GROUP BY 1, 2, 3",
    "graph_relation_hints": f"WITH {_KNOWN} SELECT kind, {_CASE(op.CONFIDENCE)} AS confidence, count(*) AS edges FROM known GROUP BY 1, 2",
    "projected_graph_hits": f"""WITH {_KNOWN}, seeds AS (SELECT 'part:' || p_partkey AS id, 1.0::DOUBLE / (p_size + 1) AS weight FROM part WHERE p_brand = 'Brand#11'),
reached AS (SELECT a.id, neighbour, max(weight * (({_CASE(op.WEIGHTS)})::DOUBLE * CASE direction WHEN 'out' THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END)) AS score FROM seeds JOIN adjacent a ON a.id = seeds.id GROUP BY 1, 2),
kept AS (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) <= 12)
SELECT neighbour AS id, round(max(score), 6) AS score, count(*) AS seeds FROM kept GROUP BY 1""",
}
