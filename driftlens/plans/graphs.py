"""Dispatch and closure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .base import registrar, table, values

QUERIES, SQL, query = registrar()

SUPERS = "('B','A'),('C','B'),('D','C'),('E','A'),('G','F')"
IMPLEMENTS = "('F','I'),('E','I')"
DEFINED = "('A','run'),('C','run'),('D','stop'),('E','run'),('F','run'),('G','run'),('B','stop')"
REFS = "('B','run'),('I','run'),('D','run'),('A','stop'),('F','run')"


@query(f"""
WITH RECURSIVE s(child, parent) AS (VALUES {SUPERS}), i(cls, interface) AS (VALUES {IMPLEMENTS}), d(cls, name) AS (VALUES {DEFINED}), r(cls, name) AS (VALUES {REFS}),
up(cls, name, anc, dist) AS (SELECT cls, name, cls, 0 FROM r UNION SELECT u.cls, u.name, s.parent, u.dist + 1 FROM up u JOIN s ON s.child = u.anc),
down(cls, name, node) AS (SELECT cls, name, cls FROM r UNION SELECT r.cls, r.name, i.cls FROM r JOIN i ON i.interface = r.cls UNION SELECT w.cls, w.name, s.child FROM down w JOIN s ON s.parent = w.node)
SELECT cls, name, target FROM (SELECT u.cls, u.name, u.anc AS target, row_number() OVER (PARTITION BY u.cls, u.name ORDER BY u.dist) AS rn FROM up u JOIN d ON d.cls = u.anc AND d.name = u.name) WHERE rn = 1
UNION SELECT w.cls, w.name, w.node FROM down w JOIN d ON d.cls = w.node AND d.name = w.name WHERE w.node <> w.cls""")
def q18_hierarchy_dispatch(spark, sf_dir):
    return graph.dispatch(values(spark, "cls, name", REFS), values(spark, "cls, name", DEFINED), values(spark, "child, parent", SUPERS), values(spark, "cls, interface", IMPLEMENTS))


#: Keys are folded so that parts and suppliers share nodes and edges form long paths; every row makes an edge.
CHAIN_EDGES = "SELECT DISTINCT l_partkey % 200 AS src, l_suppkey % 100 AS dst FROM lineitem"


def chain_edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("src"), (F.col("l_suppkey") % 100).alias("dst")).distinct()


@query(f"""
WITH RECURSIVE e AS ({CHAIN_EDGES}), r(node) AS (SELECT DISTINCT src FROM e WHERE src % 50 = 7 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r""")
def q19_internal_chain(spark, sf_dir):
    edges = chain_edges(spark, sf_dir)
    return graph.closure(edges.where("src % 50 = 7").select(F.col("src").alias("node")), edges)


@query(f"""
WITH RECURSIVE e AS ({CHAIN_EDGES}), p AS (SELECT * FROM e WHERE dst % 2 = 0), r(node) AS (SELECT DISTINCT src FROM p WHERE src % 20 = 3 UNION SELECT p.dst FROM r JOIN p ON p.src = r.node)
SELECT o.l_suppkey AS member, min(r.node) AS via FROM r JOIN lineitem o ON o.l_partkey % 200 = r.node GROUP BY o.l_suppkey""")
def q20_two_hop(spark, sf_dir):
    inside = chain_edges(spark, sf_dir).where("dst % 2 = 0")
    reached = graph.closure(inside.where("src % 20 = 3").select(F.col("src").alias("node")), inside)
    out = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("node"), F.col("l_suppkey").alias("member"))
    return out.join(reached, "node").groupBy("member").agg(F.min("node").alias("via"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, (c_custkey % 25)::INT AS dst FROM customer), r(node) AS (SELECT 3 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
SELECT node::INT AS node FROM r""")
def q21_class_level_closure(spark, sf_dir):
    edges = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 25).cast("int").alias("dst")).distinct()
    return graph.closure(spark.range(1).select(F.lit(3).alias("node")), edges)


# The same closures over every row, with the tables' own keys as nodes.
KEY_EDGES = "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem"


def key_edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@query(f"""
WITH RECURSIVE e AS ({KEY_EDGES}), r(node) AS (SELECT DISTINCT src FROM e WHERE src % 50 = 7 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r""")
def q35_internal_chain_whole(spark, sf_dir):
    edges = key_edges(spark, sf_dir)
    return graph.closure(edges.where("src % 50 = 7").select(F.col("src").alias("node")), edges)


@query(f"""
WITH RECURSIVE e AS ({KEY_EDGES}), p AS (SELECT * FROM e WHERE dst % 2 = 0), r(node) AS (SELECT DISTINCT src FROM p WHERE src % 20 = 3 UNION SELECT p.dst FROM r JOIN p ON p.src = r.node)
SELECT e.dst AS member, min(r.node) AS via FROM r JOIN e ON e.src = r.node GROUP BY e.dst""")
def q36_two_hop_whole(spark, sf_dir):
    edges = key_edges(spark, sf_dir)
    inside = edges.where("dst % 2 = 0")
    reached = graph.closure(inside.where("src % 20 = 3").select(F.col("src").alias("node")), inside)
    return edges.join(reached, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("member")).agg(F.min("node").alias("via"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), r(node) AS (SELECT 3::BIGINT UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
SELECT node FROM r""")
def q37_class_level_closure_whole(spark, sf_dir):
    edges = key_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.closure(spark.range(1).select(F.lit(3).cast("long").alias("node")), edges)
