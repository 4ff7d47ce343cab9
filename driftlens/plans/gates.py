"""Routing, status and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, router
from .base import registrar, table, values

QUERIES, SQL, query = registrar()


@query("""
WITH suite AS (SELECT c_custkey AS test FROM customer), covers AS (SELECT DISTINCT o_custkey AS test, l_partkey AS cls FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 9 <> 0),
affected AS (SELECT p_partkey AS cls, p_brand AS reason, p_size AS place FROM part WHERE p_partkey % 40 = 0 UNION ALL SELECT p_partkey, p_type, p_size - 7 FROM part WHERE p_partkey % 80 = 0),
changed AS (SELECT p_partkey AS cls FROM part WHERE p_partkey % 40 = 1),
per_class AS (SELECT cls::VARCHAR AS cls, cls AS key, string_agg(reason, ' & ' ORDER BY place, reason) AS reasons FROM affected GROUP BY 1, 2),
direct AS (SELECT test, string_agg('covers ' || p.cls || ' <- ' || reasons, '; ' ORDER BY p.cls) AS why FROM covers JOIN per_class p ON p.key = covers.cls GROUP BY test)
SELECT test, why FROM suite JOIN direct USING (test)
UNION ALL SELECT test, 'changed since the map' FROM suite WHERE test IN (SELECT test FROM covers WHERE cls IN (SELECT cls FROM changed)) AND test NOT IN (SELECT test FROM direct)
UNION ALL SELECT test, 'not in the map' FROM suite WHERE test NOT IN (SELECT test FROM covers)""")
def q22_test_selection(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("cls"))
    covers = table(spark, sf_dir, "orders").where("o_custkey % 9 <> 0").select("o_orderkey", F.col("o_custkey").alias("test")).join(items, "o_orderkey").select("test", "cls").distinct()
    part = table(spark, sf_dir, "part")
    affected = part.where("p_partkey % 40 = 0").select(F.col("p_partkey").alias("cls"), F.col("p_brand").alias("reason"), F.col("p_size").alias("at"))
    affected = affected.unionByName(part.where("p_partkey % 80 = 0").select(F.col("p_partkey").alias("cls"), F.col("p_type").alias("reason"), (F.col("p_size") - 7).alias("at")))
    changed = part.where("p_partkey % 40 = 1").select(F.col("p_partkey").alias("cls"))
    return router.select_tests(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("test")), covers, affected, changed)


FAILED = "('com.acme.OrderServiceTest.places'),('OrderServiceTestIT.total'),('lower.case.only'),('com.acme.StartupProbeIT'),('com.acme.PriceTest#rounds'),('pkg.suite.m')"
TESTS = "('OrderServiceTest'),('StartupProbeIT'),('com.acme.PriceTest'),('case'),('pkg.suite')"


@query(f"""
WITH f(name) AS (VALUES {FAILED}), t(test) AS (VALUES {TESTS}),
parts AS (SELECT x, string_split(replace(x, '#', '.'), '.') AS p FROM (SELECT name AS x FROM f UNION SELECT test FROM t)),
k AS (SELECT x, CASE WHEN len(p) = 1 THEN p[1] ELSE coalesce(list_filter(p, lambda y: regexp_matches(y, '^[A-Z]'))[-1], p[-2]) END AS token FROM parts)
SELECT DISTINCT name, test FROM f JOIN t ON true JOIN k kf ON kf.x = name JOIN k kt ON kt.x = test WHERE kf.token = test OR starts_with(name, test || '.') OR kf.token = kt.token""")
def q23_test_attribution(spark, sf_dir):
    return router.attribute(values(spark, "name", FAILED), values(spark, "test", TESTS))


ENTRIES = "('smoke','smoke',1),('rollback-path','rollback',1),('contract','contract',2)"
TAGGED = "('smoke','StartupProbeIT'),('contract','PriceTest'),('smoke','LoginIT')"


@query(f"""
WITH e(id, tag, min_resolved) AS (VALUES {ENTRIES}), g(tag, test) AS (VALUES {TAGGED})
SELECT id, count(DISTINCT test) AS resolved, count(DISTINCT test) >= any_value(min_resolved) AS ok FROM e LEFT JOIN g USING (tag) GROUP BY id""")
def q24_mandatory_obligation(spark, sf_dir):
    return router.obligations(values(spark, "id, tag, min_resolved", ENTRIES), values(spark, "tag, test", TAGGED))


FACTS = "('a',0,true,true,true,1),('b',6,false,true,true,1),('c',6,true,false,true,1),('d',6,true,true,false,1),('e',6,true,true,true,26),('f',6,true,true,true,25),('g',6,true,true,true,CAST(NULL AS INT))"
FACT_COLUMNS = "id, suite, resolved_ok, shrink_allowed, readable, age"


@query(f"""
SELECT id, CASE WHEN suite = 0 THEN 'REACHABILITY_ONLY' WHEN NOT resolved_ok THEN 'STALE_OBLIGATION' WHEN NOT shrink_allowed OR NOT readable OR coalesce(age, 1000000) > 25 THEN 'FULL' ELSE 'TARGETED' END AS mode
FROM (VALUES {FACTS}) AS t({FACT_COLUMNS})""")
def q25_router_mode(spark, sf_dir):
    return values(spark, FACT_COLUMNS, FACTS).select("id", router.mode(*(F.col(c) for c in FACT_COLUMNS.split(", ")[1:])).alias("mode"))


RUNS = "('a',false,3,0,false),('b',true,0,0,false),('c',true,2,1,false),('d',true,2,0,true),('e',true,2,0,false)"


@query(f"""
SELECT library, CASE WHEN NOT ran THEN 'not_run' WHEN selected = 0 THEN 'not_selected' WHEN failed > 0 OR aggregate_failure THEN 'failed' ELSE 'passed' END AS status
FROM (VALUES {RUNS}) AS t(library, ran, selected, failed, aggregate_failure)""")
def q26_status_case(spark, sf_dir):
    rows = values(spark, "library, ran, selected, failed, aggregate_failure", RUNS)
    return rows.select("library", router.status(F.col("ran"), F.col("selected"), F.col("failed"), F.col("aggregate_failure")).alias("status"))


@query("""
WITH g AS (SELECT o_orderpriority, o_orderstatus, max(o_orderkey % 5) FILTER (o_custkey % 3 <> 0) AS r FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus, CASE r WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'F' ELSE '?' END AS grade, CASE WHEN r <= 1 THEN 'auto' WHEN r <= 4 THEN 'human' ELSE 'fail' END AS decision FROM g""")
def q33_cab_gate(spark, sf_dir):
    worst = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.max(F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderkey") % 5)).alias("r"))
    grade = F.coalesce(F.get(F.array(*map(F.lit, "ABCDF")), F.col("r").cast("int")), F.lit("?"))
    return worst.select("o_orderpriority", "o_orderstatus", grade.alias("grade")).withColumn("decision", router.cab_decision(F.col("grade")))


GATE = "('smoke','OPEN','run it'),('rollback-path','OPEN','rehearse'),('canary','CLOSED','done')"
UPDATES = "('rollback-path','CLOSED',CAST(NULL AS STRING)),('extra','CLOSED','new')"


@query(f"""
WITH g(id, status, note) AS (VALUES {GATE}), u(id, status, note) AS (VALUES {UPDATES})
SELECT id, coalesce(u.status, g.status) AS status, coalesce(u.note, g.note) AS note FROM g FULL JOIN u USING (id)""")
def q34_gate_upsert(spark, sf_dir):
    return diff.upsert(values(spark, "id, status, note", GATE), values(spark, "id, status, note", UPDATES), "id")


@query("""
WITH g AS (SELECT o_custkey, max(o_orderkey % 6) AS r FROM orders GROUP BY 1)
SELECT o_custkey, CASE r WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'F' ELSE '?' END AS grade, CASE WHEN r <= 1 THEN 'auto' WHEN r <= 4 THEN 'human' ELSE 'fail' END AS decision FROM g""")
def q38_cab_gate_whole(spark, sf_dir):
    """The gate over every order, one verdict a customer."""
    worst = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderkey") % 6).alias("r"))
    grade = F.coalesce(F.get(F.array(*map(F.lit, "ABCDF")), F.col("r").cast("int")), F.lit("?"))
    return worst.select("o_custkey", grade.alias("grade")).select("o_custkey", "grade", router.cab_decision(F.col("grade")).alias("decision"))
