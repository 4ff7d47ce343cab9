"""Queries that run the library and application operators over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, delta, graph, hazards, router, use
from ..sources import projects
from .base import registrar, table

QUERIES, SQL, query = registrar()

BITS = "(p_partkey % 2 + 8 * (p_size % 2) + 16 * (CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END))"
NEW_BITS = "((CASE WHEN p_partkey % 6 = 1 THEN 0 ELSE p_partkey % 2 END) + 8 * (p_size % 2) + 16 * (CASE WHEN p_partkey % 15 = 0 THEN 1 ELSE 0 END))"


def members(spark, sf_dir):
    """Parts as members of their brand's old and new archive; every fourth part stands for a class."""
    part = table(spark, sf_dir, "part")
    key = [F.concat(F.lit("c/"), "p_type").alias("cls"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("desc")]
    side = lambda name, keep, bits: part.where(keep).select(F.concat(F.lit(name), "p_brand").alias("path"), *key, F.expr(bits).cast("int").alias("access")).groupBy("path", "cls", "name", "desc").agg(F.max("access").alias("access"))
    pairs = part.select("p_brand").distinct().select(F.col("p_brand").alias("pair"), F.concat(F.lit("old"), "p_brand").alias("old_path"), F.concat(F.lit("new"), "p_brand").alias("new_path"))
    return pairs, side("old", "p_partkey % 10 <> 0", BITS).unionByName(side("new", "p_partkey % 7 <> 0", NEW_BITS))


MEMBERS = f"""
m AS (SELECT p_brand AS pair, 'c/' || p_type AS cls, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey::VARCHAR END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS d, p_partkey, {BITS}::INT AS a, {NEW_BITS}::INT AS b FROM part),
o AS (SELECT pair, cls, name, d, max(a) AS a FROM m WHERE p_partkey % 10 <> 0 GROUP BY 1, 2, 3, 4), n AS (SELECT pair, cls, name, d, max(b) AS b FROM m WHERE p_partkey % 7 <> 0 GROUP BY 1, 2, 3, 4),
j AS (SELECT coalesce(o.pair, n.pair) AS pair, coalesce(o.cls, n.cls) AS cls, coalesce(o.name, n.name) AS name, coalesce(o.d, n.d) AS d, a, b FROM o FULL JOIN n ON o.pair = n.pair AND o.cls = n.cls AND o.name IS NOT DISTINCT FROM n.name AND o.d IS NOT DISTINCT FROM n.d),
changes AS (SELECT pair, cls, name, d, CASE WHEN b IS NULL THEN 'removed' WHEN a IS NULL THEN 'added' ELSE 'modified' END AS change,
  b IS NULL OR (a IS NOT NULL AND ((a & 1 = 1 AND b & 1 = 0) OR (a & 16 = 0 AND b & 16 = 16) OR (a & 8) <> (b & 8))) AS incompatible FROM j WHERE a IS NULL OR b IS NULL OR a <> b)"""


@query(f"WITH {MEMBERS} SELECT pair, cls, name, d AS \"desc\", change, incompatible FROM changes")
def q39_member_deltas(spark, sf_dir):
    return delta.member_changes(*members(spark, sf_dir))


@query(f"""
WITH {MEMBERS},
refs AS (SELECT DISTINCT l_orderkey AS app, l_suppkey::VARCHAR AS owner, p_brand AS pair, 'c/' || p_type AS cls, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey::VARCHAR END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT r.*, c.change, coalesce(c.incompatible, false) AS broken FROM refs r LEFT JOIN changes c ON c.pair = r.pair AND c.cls = r.cls AND c.name IS NOT DISTINCT FROM r.name AND c.d IS NOT DISTINCT FROM r.d)
SELECT app, pair, count(DISTINCT (cls, name, d)) FILTER (name IS NOT NULL) AS lib_call_sites, count(DISTINCT cls) FILTER (name IS NULL) AS n_classes,
  count(DISTINCT (cls, name, d)) FILTER (name IS NOT NULL AND change IN ('removed', 'modified')) AS n_changed,
  count(DISTINCT (cls, name, d)) FILTER ((name IS NOT NULL AND broken) OR (name IS NULL AND change = 'removed')) AS n_broken,
  array_to_string(list_sort(list(DISTINCT owner)), ',') AS owners, coalesce(array_to_string(list_sort(list(DISTINCT owner) FILTER (change IN ('removed', 'modified') OR broken)), ','), '') AS owners_changed
FROM t GROUP BY app, pair""")
def q40_one_hop_use(spark, sf_dir):
    pairs, rows = members(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_partkey", "p_brand", "p_type", "p_name")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(part, "l_partkey")
    # a brand is a library of its own: its name is part of the package, so references meet their brand only
    package = F.concat(F.lit("c/"), "p_brand")
    refs = items.select(F.col("l_orderkey").alias("app"), F.col("l_suppkey").cast("string").alias("owner"), F.concat(package, F.lit("/"), "p_type").alias("cls"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("desc")).distinct()
    held = pairs.select("pair", F.concat(F.lit("c/"), "pair").alias("package"))
    changes = delta.member_changes(pairs, rows).withColumn("cls", F.concat(F.lit("c/"), "pair", F.lit("/"), F.substring("cls", 3, 1000)))
    found = use.intersect(refs, held, changes, spark.createDataFrame([], "pair string, cls string, status string"))
    return found.select("app", "pair", "lib_call_sites", F.size("lib_classes_used").cast("long").alias("n_classes"), F.size("touched_changed").cast("long").alias("n_changed"), F.size("touched_incompatible").cast("long").alias("n_broken"), F.array_join("affected_app_classes", ",").alias("owners"), F.array_join("affected_app_classes_changed", ",").alias("owners_changed"))


HEAP = "SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1"


@query(f"""
WITH RECURSIVE s AS ({HEAP}), d AS (SELECT p_partkey AS cls, p_size % 3 AS name FROM part WHERE p_partkey % 5 < 2), i AS (SELECT DISTINCT ps AS cls, -sk AS interface FROM (SELECT l_partkey AS ps, l_suppkey AS sk FROM lineitem WHERE l_linenumber = 1)),
r AS (SELECT p_partkey AS cls, p_size % 3 AS name FROM part WHERE p_partkey % 11 = 3 UNION SELECT -s_suppkey, s_nationkey % 3 FROM supplier),
up(cls, name, anc, dist) AS (SELECT cls, name, cls, 0 FROM r UNION SELECT u.cls, u.name, s.parent, u.dist + 1 FROM up u JOIN s ON s.child = u.anc),
down(cls, node) AS (SELECT DISTINCT cls, cls FROM r UNION SELECT r.cls, i.cls FROM r JOIN i ON i.interface = r.cls UNION SELECT w.cls, s.child FROM down w JOIN s ON s.parent = w.node)
SELECT cls, name, target FROM (SELECT u.cls, u.name, u.anc AS target, row_number() OVER (PARTITION BY u.cls, u.name ORDER BY u.dist) AS rn FROM up u JOIN d ON d.cls = u.anc AND d.name = u.name) WHERE rn = 1
UNION SELECT w.cls, r.name, w.node FROM down w JOIN r ON r.cls = w.cls JOIN d ON d.cls = w.node AND d.name = r.name WHERE w.node <> w.cls""")
def q41_dispatch_whole(spark, sf_dir):
    """Parts as a binary tree of classes, suppliers as interfaces of the parts they deliver first."""
    part = table(spark, sf_dir, "part")
    supers = part.where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    name = F.col("p_size") % 3
    defined = part.where("p_partkey % 5 < 2").select(F.col("p_partkey").alias("cls"), name.alias("name"))
    implements = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("cls"), (-F.col("l_suppkey")).alias("interface")).distinct()
    refs = part.where("p_partkey % 11 = 3").select(F.col("p_partkey").alias("cls"), name.alias("name")).union(table(spark, sf_dir, "supplier").select(-F.col("s_suppkey"), F.col("s_nationkey") % 3))
    return graph.dispatch(refs, defined, supers, implements)


@query("""
WITH b AS (SELECT p_brand AS grp, p_partkey::VARCHAR AS artifact, CASE WHEN p_size % 5 = 0 THEN '${v}' ELSE p_size::VARCHAR END AS v FROM part WHERE p_partkey % 10 <> 0),
h AS (SELECT p_brand AS grp, p_partkey::VARCHAR AS artifact, CASE WHEN p_size % 11 = 0 THEN '${w}' WHEN p_partkey % 3 = 0 THEN p_size || '.rhlw-00001' ELSE p_size::VARCHAR END AS v FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(b.grp, h.grp) AS grp, coalesce(b.artifact, h.artifact) AS artifact, b.v AS old_version, h.v AS new_version, CASE WHEN h.v IS NULL THEN 'removed' WHEN b.v IS NULL THEN 'added' ELSE 'changed' END AS change,
  b.v IS NOT NULL AND coalesce(h.v LIKE '%.rhlw-00001', false) AS adopted
FROM b FULL JOIN h ON b.grp = h.grp AND b.artifact = h.artifact WHERE b.v IS DISTINCT FROM h.v AND NOT coalesce(starts_with(b.v, '$'), false) AND NOT coalesce(starts_with(h.v, '$'), false)""")
def q42_pom_changes(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("string"))
    side = lambda keep, version: part.where(keep).select(F.col("p_brand").alias("grp"), F.col("p_partkey").cast("string").alias("artifact"), version.alias("version"), F.lit(0).alias("at"))
    base = side("p_partkey % 10 <> 0", F.when(F.col("p_size") % 5 == 0, "${v}").otherwise(F.col("size")))
    head = side("p_partkey % 7 <> 0", F.when(F.col("p_size") % 11 == 0, "${w}").when(F.col("p_partkey") % 3 == 0, F.concat("size", F.lit(".rhlw-00001"))).otherwise(F.col("size")))
    return projects.pom_changes(base, head)


@query("""
WITH c AS (SELECT DISTINCT p_brand AS grp, p_type AS artifact, p_size % 12 AS v FROM part), k AS (SELECT DISTINCT p_brand AS grp, p_type AS artifact, p_size % 7 AS v FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT c.grp, c.artifact, c.v, coalesce(bool_or(k.v = c.v), false) AS exact, coalesce(bool_or(k.v >= c.v), false) AS later FROM c LEFT JOIN k ON c.grp = k.grp AND c.artifact = k.artifact GROUP BY 1, 2, 3)
SELECT count(*) AS dependencies, count(*) FILTER (exact) AS exact, count(*) FILTER (NOT exact AND later) AS serviced_other_version, count(*) FILTER (NOT exact AND NOT later) AS uncovered, round_even(100.0 * count(*) FILTER (exact) / count(*), 0)::INT AS exact_pct FROM b""")
def q43_catalog_totals(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = lambda df, mod: df.select(F.col("p_brand").alias("grp"), F.col("p_type").alias("artifact"), (F.col("p_size") % mod).cast("string").alias("version")).distinct()
    held = rows(part.where("p_partkey % 2 = 0"), 7).select("grp", "artifact", F.col("version").alias("base_version"), F.concat("version", F.lit(".rhlw-1")).alias("full_version"))
    return catalog.totals(catalog.bucket(rows(part, 12), held))


@query("""
WITH d AS (SELECT c_nationkey AS app, c_custkey::VARCHAR AS artifact, (c_custkey % 4)::VARCHAR AS v FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_nationkey AS app, c_custkey::VARCHAR AS artifact, (c_custkey % 5)::VARCHAR AS v FROM customer WHERE c_custkey % 4 <> 0 AND c_nationkey % 6 <> 0)
SELECT coalesce(d.app, s.app) AS app, coalesce(d.artifact, s.artifact) AS artifact, d.v AS declared, s.v AS shipped, CASE WHEN s.v IS NULL THEN 'declared-not-shipped' WHEN d.v IS NULL THEN 'shipped-not-declared' ELSE 'version-drift' END AS kind
FROM (SELECT * FROM d WHERE app IN (SELECT app FROM s)) d FULL JOIN s ON d.app = s.app AND d.artifact = s.artifact WHERE d.v IS DISTINCT FROM s.v""")
def q44_declared_and_shipped(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    side = lambda keep, mod: customer.where(keep).select(F.col("c_nationkey").alias("app"), F.col("c_custkey").cast("string").alias("artifact"), (F.col("c_custkey") % mod).cast("string").alias("version"))
    return hazards.drift(side("c_custkey % 4 <> 0 AND c_nationkey % 6 <> 0", 5), side("c_custkey % 3 <> 0", 4))


NAMES = "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '[a-zA-Z_$][\\w$]*(?:\\.[a-zA-Z_$][\\w$]*){2,}')) AS fqcn FROM pages"


@query(f"""
WITH n AS ({NAMES}), held AS (SELECT DISTINCT regexp_extract(fqcn, '^[^.]+\\.[^.]+', 0) AS package FROM n WHERE page_id % 2 = 0)
SELECT page_id::VARCHAR AS app, package AS pair, fqcn, 'resource:x' AS found_in FROM n JOIN held ON regexp_extract(fqcn, '^(.*)\\.[^.]+$', 1) = package OR starts_with(regexp_extract(fqcn, '^(.*)\\.[^.]+$', 1), package || '.')""")
def q45_name_hits(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    entries = pages.select(F.col("page_id").cast("string").alias("app"), F.lit("x").alias("entry"), F.lit("resource").alias("kind"), F.col("html").alias("text"), F.lit(None).cast("string").alias("cls"), F.array().cast("array<string>").alias("strings"))
    names = pages.where("page_id % 2 = 0").select(F.explode(hazards.class_names(F.col("html"))).alias("n"))
    held = names.select(F.regexp_extract("n", r"^[^.]+\.[^.]+", 0).alias("pair")).distinct().select("pair", F.replace("pair", F.lit("."), F.lit("/")).alias("package"))
    return hazards.name_hits(entries, held).withColumn("found_in", F.array_join("found_in", ","))


@query("""
WITH covers AS (SELECT DISTINCT o_custkey AS test, l_partkey AS cls FROM orders JOIN lineitem ON o_orderkey = l_orderkey), affected AS (SELECT p_brand AS library, p_partkey AS cls FROM part WHERE p_partkey % 50 = 0),
by_ AS (SELECT DISTINCT library, test FROM covers JOIN affected USING (cls) WHERE test % 2 = 0),
f AS (SELECT DISTINCT c_custkey AS test FROM customer WHERE c_custkey % 14 = 0)
SELECT l.library, count(b.test) AS selected_count, count(f.test) AS n_failed, CASE WHEN count(b.test) = 0 THEN 'not_selected' WHEN count(f.test) > 0 THEN 'failed' ELSE 'passed' END AS status
FROM (SELECT DISTINCT p_brand AS library FROM part) l LEFT JOIN by_ b USING (library) LEFT JOIN f ON f.test = b.test GROUP BY l.library""")
def q46_results_by_library(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("cls"))
    test = F.concat(F.lit("T"), F.col("o_custkey").cast("string"))
    covers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(items, "o_orderkey").select(test.alias("test"), "cls").distinct()
    part = table(spark, sf_dir, "part")
    customer = table(spark, sf_dir, "customer")
    entries = customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("test"), F.lit("whole suite").alias("reason"))
    libraries = part.select(F.col("p_brand").alias("library")).distinct()
    affected = part.where("p_partkey % 50 = 0").select(F.col("p_brand").alias("library"), F.col("p_partkey").alias("cls"))
    by = router.tests_by_library(entries, libraries, covers, affected)
    failed = customer.where("c_custkey % 14 = 0").select(F.concat(F.lit("pkg.T"), F.col("c_custkey").cast("string"), F.lit(".m")).alias("name"))
    found = router.results_by_library(by, libraries, failed, True, 1)
    return found.select("library", F.col("selected_count").cast("long").alias("selected_count"), F.size("failed_names").cast("long").alias("n_failed"), "status")


@query("""
WITH r AS (SELECT DISTINCT o_custkey AS app, p_brand AS package FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
own AS (SELECT c_custkey AS app, 'Brand#' || (c_custkey % 5 + 1) || (c_custkey % 4 + 1) AS package FROM customer), rated AS (SELECT DISTINCT p_brand AS package FROM part WHERE p_partkey % 9 = 0 AND p_size > 45)
SELECT app, package FROM r WHERE (app, package) NOT IN (SELECT (app, package) FROM own) AND package NOT IN (SELECT package FROM rated)""")
def q47_unrated_packages(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(part, "l_partkey")
    refs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(items, "o_orderkey").select(F.col("o_custkey").alias("app"), F.concat("p_brand", F.lit("/C")).alias("cls"), F.lit("m").alias("name")).distinct()
    brand = F.concat(F.lit("Brand#"), (F.col("c_custkey") % 5 + 1).cast("string"), (F.col("c_custkey") % 4 + 1).cast("string"), F.lit("/Own"))
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("app"), F.lit("class").alias("kind"), brand.alias("cls"))
    rated = part.where("l_partkey % 9 = 0 AND p_size > 45").select(F.col("p_brand").alias("package"))
    return use.third_party_packages(refs, entries, rated)
