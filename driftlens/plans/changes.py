"""Queries of the diff, use and rollup families on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import members
from ..operators import diff, grading, hazards
from .base import registrar, table

QUERIES, SQL, query = registrar()

PART_SNAPSHOTS = """
old AS (SELECT p_partkey, p_brand, p_size::BIGINT AS p_size FROM part WHERE p_partkey % 10 <> 0),
new AS (SELECT p_partkey, p_brand, (p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS p_size FROM part WHERE p_partkey % 7 <> 0)"""


def part_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("p_size"))
    new = part.where(F.col("p_partkey") % 7 != 0).withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0))
    return part.where(F.col("p_partkey") % 10 != 0), new


@query(f"""
WITH {PART_SNAPSHOTS}
SELECT o.p_partkey, 'removed' AS change FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.p_partkey = o.p_partkey)
UNION ALL SELECT n.p_partkey, 'added' FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.p_partkey = o.p_partkey)
UNION ALL SELECT o.p_partkey, 'modified' FROM old o JOIN new n USING (p_partkey) WHERE o.p_size <> n.p_size OR o.p_brand <> n.p_brand""")
def q01_snapshot_diff(spark, sf_dir):
    return diff.snapshot_diff(*part_snapshots(spark, sf_dir), ["p_partkey"], ["p_brand", "p_size"])


@query("""
WITH bits AS (
  SELECT o_orderkey,
    (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) | (CASE WHEN o_orderpriority LIKE '1%' THEN 8 ELSE 0 END) | (CASE WHEN o_custkey % 3 = 0 THEN 16 ELSE 0 END) AS a,
    (CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderkey % 4 <> 0 THEN 1 ELSE 0 END) | (CASE WHEN o_orderpriority LIKE '1%' OR o_orderkey % 11 = 0 THEN 8 ELSE 0 END) | (CASE WHEN o_custkey % 5 = 0 THEN 16 ELSE 0 END) | (CASE WHEN o_orderkey % 13 = 0 THEN 1024 ELSE 0 END) AS b
  FROM orders)
SELECT o_orderkey, ((a & 1) <> 0 AND (b & 1) = 0) OR ((b & 16) <> 0 AND (a & 16) = 0) OR ((b & 1024) <> 0 AND (a & 1024) = 0) OR ((a & 8) <> (b & 8)) AS incompatible
FROM bits WHERE a <> b""")
def q02_incompatible_flags(spark, sf_dir):
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    status, key, cust = F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_custkey")
    urgent = F.col("o_orderpriority").startswith("1")
    old = bit(status == "F", 1) + bit(urgent, 8) + bit(cust % 3 == 0, 16)
    new = bit(status.isin("F", "O") & (key % 4 != 0), 1) + bit(urgent | (key % 11 == 0), 8) + bit(cust % 5 == 0, 16) + bit(key % 13 == 0, 1024)
    both = table(spark, sf_dir, "orders").select("o_orderkey", old.alias("a"), new.alias("b"))
    return both.where("a <> b").select("o_orderkey", members.narrowed(F.col("a"), F.col("b")).alias("incompatible"))


@query("""
WITH old AS (SELECT doc_id, text AS raw FROM documents),
new AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'changed ' || text WHEN doc_id % 10 = 7 THEN text || '  ' ELSE text END AS raw FROM documents),
both_ AS (SELECT o.doc_id, sha256(o.raw) AS r1, sha256(n.raw) AS r2, sha256(rtrim(o.raw, ' ')) AS f1, sha256(rtrim(n.raw, ' ')) AS f2 FROM old o JOIN new n USING (doc_id)),
c AS (SELECT count(*) AS n_common, count(*) FILTER (r1 <> r2) AS raw, count(*) FILTER (r1 <> r2 AND f1 <> f2) AS n_changed FROM both_)
SELECT n_common, n_changed, raw - n_changed AS n_noise, CASE WHEN n_common = 0 THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE * n_changed / n_common, 1) END AS churn_pct FROM c""")
def q03_content_churn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slot = F.col("doc_id") % 10
    changed = docs.withColumn("text", F.when(slot == 3, F.concat(F.lit("changed "), "text")).when(slot == 7, F.concat("text", F.lit("  "))).otherwise(F.col("text")))
    prints = lambda d: d.select("doc_id", F.sha2("text", 256).alias("raw"), F.sha2(F.rtrim("text"), 256).alias("print"))
    return diff.content_churn(prints(docs), prints(changed), "doc_id", "raw", "print")


@query(f"""
WITH {PART_SNAPSHOTS}
SELECT p_partkey, o.p_size AS old_value, n.p_size AS new_value,
  CASE WHEN n.p_size IS NULL THEN 'removed' WHEN o.p_size IS NULL THEN 'added' WHEN o.p_size <> n.p_size THEN 'changed' ELSE 'same' END AS status
FROM old o FULL JOIN new n USING (p_partkey)""")
def q04_three_way_full_outer(spark, sf_dir):
    return diff.three_way(*part_snapshots(spark, sf_dir), "p_partkey", "p_size")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' OR l_quantity > 45)")
def q05_touch_semi(spark, sf_dir):
    changed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' OR l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(changed, "o_orderkey", "left_semi")


@query("""
SELECT o_custkey, count(DISTINCT l_partkey) AS n_touched, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS kinds
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount >= 0.05 GROUP BY o_custkey""")
def q06_touch_owner(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").where("l_discount >= 0.05D").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag")
    owned = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(calls, "o_orderkey")
    return owned.groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("n_touched"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("kinds"))


@query("""
SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n_uses FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_totalprice > 1000 GROUP BY c_custkey, c_mktsegment""")
def q07_unused_dropped(spark, sf_dir):
    uses = table(spark, sf_dir, "orders").where("o_totalprice > 1000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_uses"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(uses, "c_custkey")


@query("""
WITH o AS (SELECT l_partkey, l_orderkey, l_linenumber, (l_orderkey % 5)::INT AS g, l_returnflag = 'N' AS in_place FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY g, NOT in_place, l_orderkey, l_linenumber) AS up, row_number() OVER (PARTITION BY l_partkey ORDER BY g DESC, (NOT in_place) DESC, l_orderkey DESC, l_linenumber DESC) AS down FROM o)
SELECT l_partkey, max(g) FILTER (up = 1) AS best, max(l_orderkey) FILTER (up = 1) AS best_order, max(g) FILTER (down = 1) AS worst, max(l_orderkey) FILTER (down = 1) AS worst_order FROM r GROUP BY l_partkey""")
def q08_best_worst_option(spark, sf_dir):
    options = table(spark, sf_dir, "lineitem").select("l_partkey", F.struct((F.col("l_orderkey") % 5).cast("int").alias("g"), (F.col("l_returnflag") != "N").alias("later"), "l_orderkey", "l_linenumber").alias("o"))
    return options.groupBy("l_partkey").agg(F.min("o").alias("b"), F.max("o").alias("w")).select("l_partkey", F.col("b.g").alias("best"), F.col("b.l_orderkey").alias("best_order"), F.col("w.g").alias("worst"), F.col("w.l_orderkey").alias("worst_order"))


GRADE_FACTS = """
facts AS (
  SELECT p_brand AS library, CASE p_size % 4 WHEN 0 THEN 'z' WHEN 1 THEN 'y' WHEN 2 THEN 'x' ELSE 'z' END AS stream,
    count(*) FILTER (p_partkey % 97 = 0) AS incompatible, count(*) FILTER (p_partkey % 89 = 0) AS modified, count(*) FILTER (p_partkey % 31 = 0) AS added,
    round(100.0::DOUBLE * count(*) FILTER (p_partkey % 13 = 0) / count(*), 1) AS churn, count(*) FILTER (p_partkey % 53 = 0) AS resources, count(*) FILTER (p_partkey % 71 = 0) AS spi
  FROM part GROUP BY 1, 2)"""
GRADE_CASE = """CASE stream WHEN 'z' THEN CASE WHEN incompatible > 0 OR modified > 0 THEN 'D' WHEN added > 0 OR churn >= 10 OR resources > 0 OR spi > 0 THEN 'B' ELSE 'A' END
  WHEN 'y' THEN CASE WHEN incompatible > 0 THEN 'D' ELSE 'C' END ELSE 'D' END"""


def grade_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda n: F.count_if(F.col("p_partkey") % n == 0)
    size = F.col("p_size") % 4
    stream = F.when(size == 1, "y").when(size == 2, "x").otherwise("z")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("library"), stream.alias("stream")).agg(
        of(97).alias("incompatible"), of(89).alias("modified"), of(31).alias("added"), F.round(F.lit(100.0) * of(13) / F.count("*"), 1).alias("churn"), of(53).alias("resources"), of(71).alias("spi")
    )


@query(f"""
WITH {GRADE_FACTS}, graded AS (SELECT *, {GRADE_CASE} AS base FROM facts)
SELECT library, stream, incompatible, modified, added, churn, base,
  CASE WHEN incompatible >= 2 THEN 'F' WHEN modified >= 2 THEN base WHEN base = 'A' AND added % 2 = 1 THEN 'B' ELSE base END AS grade FROM graded""")
def q09_grade_rules(spark, sf_dir):
    c = F.col
    base = grading.base_grade(c("stream"), c("incompatible"), c("modified"), c("added"), c("churn"), c("resources"), c("spi"))
    used = grading.grade_with_use(c("base"), c("incompatible") >= 2, c("modified") >= 2, F.lit(False), F.lit(False), c("added") % 2 == 1)
    return grade_facts(spark, sf_dir).withColumn("base", base).select("library", "stream", "incompatible", "modified", "added", "churn", "base", used.alias("grade"))


@query("""
SELECT o_orderstatus AS lane, count(*) FILTER (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS n_direct, count(*) FILTER (NOT (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')) AS n_transitive
FROM orders GROUP BY o_orderstatus""")
def q10_lane_histogram(spark, sf_dir):
    libraries = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("lane"), (~F.col("o_orderpriority").rlike("^[12]")).alias("transitive"))
    return grading.lane_histogram(libraries)


@query("SELECT c_nationkey, coalesce(bool_and(c_acctbal > -900), false) AS shrink_allowed FROM customer GROUP BY c_nationkey")
def q11_all_lanes_shrinkable(spark, sf_dir):
    graded = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_acctbal") > -900, "B").otherwise("D").alias("grade"), F.lit(None).cast("string").alias("effective_grade"))
    return grading.shrink_allowed(graded, ["c_nationkey"])


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '[a-zA-Z_$][\\w$]*(?:\\.[a-zA-Z_$][\\w$]*){2,}')) AS name FROM pages")
def q15_fqcn_hits(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(members.class_names(F.col("html"))).alias("name"))


@query("""
WITH hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
SELECT page_id, host FROM pages JOIN hosts ON host <> '' AND strpos(url, host || '/') > 1""")
def q16_relocated_substring(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).distinct().where("host <> ''")
    entries = pages.select(F.col("page_id").alias("app"), F.col("url").alias("entry"), F.lit("class").alias("kind"))
    found = hazards.relocated(entries, hosts.select(F.col("host").alias("pair"), F.col("host").alias("package")))
    return found.select(F.col("app").alias("page_id"), F.col("pair").alias("host")).distinct()


@query("""
WITH declared AS (SELECT n_name AS name, (n_nationkey % 4)::BIGINT AS version FROM nation WHERE n_nationkey % 3 <> 0),
shipped AS (SELECT n_name AS name, (n_nationkey % 5)::BIGINT AS version FROM nation WHERE n_nationkey % 4 <> 0)
SELECT name, CASE WHEN d.version IS NULL THEN 'shipped-not-declared' WHEN s.version IS NULL THEN 'declared-not-shipped' ELSE 'version-drift' END AS kind
FROM declared d FULL JOIN shipped s USING (name) WHERE d.version IS DISTINCT FROM s.version""")
def q17_sbom_vs_shipped(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    pick = lambda skip, mod: nation.where(F.col("n_nationkey") % skip != 0).select(F.col("n_name").alias("name"), (F.col("n_nationkey") % mod).cast("long").alias("version"))
    names = {"removed": "declared-not-shipped", "added": "shipped-not-declared", "changed": "version-drift"}
    kind = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("status")]
    return diff.three_way(pick(3, 4), pick(4, 5), "name", "version").where("status <> 'same'").select("name", kind.alias("kind"))


@query("""
WITH a AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT k, v FROM a UNION ALL SELECT k, v FROM b WHERE k NOT IN (SELECT k FROM a)""")
def q27_priority_union(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    first = rows.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(0).alias("o"))
    second = rows.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.lit(1).alias("o"))
    return diff.priority_union(first, second, "k", "o").select("k", "v")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY o_custkey")
def q28_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("last_status"), "o_orderdate")
    return diff.last_wins(rows, ["o_custkey"], ["o_orderdate", "last_order"]).select("o_custkey", "last_order", "last_status")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, sum(value) >= 0 AS positive FROM events GROUP BY 1")
def q29_json_unpack(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), (F.sum("value") >= 0).alias("positive"))


@query("SELECT user_id, bool_or(event_type = 'purchase') AS covered, count(*) AS n_blocks FROM events GROUP BY user_id")
def q30_probe_or(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("covered"), F.count("*").alias("n_blocks"))


@query("""
WITH o AS (SELECT l_suppkey, l_partkey, (l_orderkey % 5)::INT AS g, (l_orderkey % 3)::INT AS e, l_returnflag = 'N' AS in_place FROM lineitem),
best AS (SELECT l_suppkey, l_partkey, min(e) AS be, max(e) AS we FROM o GROUP BY 1, 2),
per AS (SELECT b.l_suppkey, b.l_partkey, b.be, max(o.g) AS wg FROM best b JOIN o ON o.l_suppkey = b.l_suppkey AND o.l_partkey = b.l_partkey AND o.e = b.we
  AND (NOT o.in_place) = (SELECT max(NOT i.in_place) FROM o i WHERE i.l_suppkey = b.l_suppkey AND i.l_partkey = b.l_partkey AND i.e = b.we) GROUP BY 1, 2, 3)
SELECT l_suppkey, substr('ABCDF', max(be) + 1, 1) AS project_grade, substr('ABCDF', max(wg) + 1, 1) AS without_best_path, count(*) AS n_libraries FROM per GROUP BY l_suppkey""")
def q31_project_rollup(spark, sf_dir):
    grade = lambda mod: grading.unrank((F.col("l_orderkey") % mod).cast("int"))
    options = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("library"), grade(5).alias("grade"), grade(3).alias("effective_grade"), (F.col("l_returnflag") == "N").alias("in_place"))
    return grading.project_rollup(options, ["l_suppkey"])


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, rn FROM (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber)::INT AS rn FROM lineitem) WHERE rn <= 4""")
def q32_top_members(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", rank.alias("rn")).where("rn <= 4")
