"""Version, catalog and advisory queries over inline fixtures that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import versions as v
from ..operators import catalog
from .base import registrar, values

QUERIES, SQL, query = registrar()

VERSION_PAIRS = "('5.3.18','5.3.18.rhlw-00003'),('2.6.0','2.8.0'),('1.30','1.33'),('1.33','1.33.0'),('1.0.0-beta','1.0.0'),('2','10'),('bad','also.bad'),('1.2.3','1.2.3'),('4.1.0.redhat-1','4.1.0')"
#: DuckDB's side of the loose version key, as one sortable string per segment.
KEY = "list_transform(regexp_split_to_array({0}, '[.\\-+]'), lambda s: CASE WHEN regexp_full_match(s, '\\d+') THEN '0' || lpad(s, 38, '0') ELSE '1' || s END)"


@query(f"""
SELECT a, b, CASE WHEN string_split(a, '.')[1] <> string_split(b, '.')[1] THEN 'x' WHEN len(string_split(a, '.')) > 1 AND len(string_split(b, '.')) > 1 AND string_split(a, '.')[2] <> string_split(b, '.')[2] THEN 'y' ELSE 'z' END AS stream,
  regexp_replace(b, '[.-](rhlw|redhat)-\\d+$', '') AS base, regexp_matches(b, '[.-](rhlw|redhat)-\\d+') AS remediated,
  a = b OR {KEY.format("b")} >= {KEY.format("a")} AS satisfied
FROM (VALUES {VERSION_PAIRS}) AS t(a, b)""")
def q12_version_compare(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return values(spark, "a, b", VERSION_PAIRS).select("a", "b", v.classify_stream(a, b).alias("stream"), v.base_version(b).alias("base"), v.is_remediated(b).alias("remediated"), v.satisfies(b, a).alias("satisfied"))


COMPONENTS = "('org.alpha','core','5.3.18'),('org.alpha','core','5.3.18.rhlw-00002'),('org.alpha','core','5.2.0'),('org.alpha','core','6.0.0'),('org.beta','yaml','1.33'),('com.gamma','json','2.6.0'),('com.delta','none','1.0')"
CATALOG = "('org.alpha','core','5.3.18','5.3.18.rhlw-00002'),('org.alpha','core','5.3.20','5.3.20.rhlw-00001'),('org.beta','yaml','1.33.0','1.33.0.rhlw-00001'),(NULL,'json','2.6.0','2.6.0.rhlw-00001')"


@query(f"""
WITH c(grp, artifact, version) AS (VALUES {COMPONENTS}), k(grp, artifact, base_version, full_version) AS (VALUES {CATALOG}),
m AS (SELECT c.*, k.base_version, k.full_version AS fv, {KEY.format("base_version")} AS bk, {KEY.format("regexp_replace(version, '[.-](rhlw|redhat)-\\d+$', '')")} AS vk
  FROM c LEFT JOIN k ON c.artifact = k.artifact AND (c.grp = k.grp OR k.grp IS NULL AND NOT EXISTS (SELECT 1 FROM k o WHERE o.grp = c.grp AND o.artifact = c.artifact))),
b AS (SELECT grp, artifact, version,
  CASE WHEN bool_or(coalesce(base_version = version OR fv = version, false)) THEN 'exact' WHEN bool_or(coalesce(bk >= vk, false)) THEN 'near' ELSE 'uncovered' END AS bucket,
  coalesce(max(fv) FILTER (base_version = version), max(fv) FILTER (fv = version)) AS full_version, string_agg(fv, ',' ORDER BY bk) FILTER (bk >= vk) AS forward
FROM m GROUP BY grp, artifact, version)
SELECT grp, artifact, version, bucket, full_version, CASE WHEN bucket = 'near' THEN forward END AS serviced FROM b""")
def q13_catalog_bucket(spark, sf_dir):
    found = catalog.bucket(values(spark, "grp, artifact, version", COMPONENTS), values(spark, "grp, artifact, base_version, full_version", CATALOG))
    return found.withColumn("serviced", F.array_join("serviced", ","))


TARGETS = "('org.alpha','core','5.3.20.rhlw-00001'),('org.alpha','core','6.1.0'),('com.gamma','json','2.8.0-redhat-2'),('org.beta','yaml','1.33'),('org.beta','yaml','1.32.rhlw-7')"
ADVISORIES = "('CVE-1','org.alpha:core','5.3.18','first'),('CVE-1','core','5.3.20.rhlw-00001','second'),('CVE-1','core','5.3.20.rhlw-00000','lower'),('CVE-2','org.alpha:core','6.0.0','later'),('CVE-3','json','2.7.0','gamma'),('CVE-3','com.gamma:json','2.6.5','lower'),('CVE-4','other:yaml','1.32','yaml'),('CVE-5','notjson','1.0','no')"


@query(f"""
WITH t(grp, artifact, version) AS (VALUES {TARGETS}), a(cve, package, fixed, summary) AS (VALUES {ADVISORIES}),
m AS (SELECT t.artifact, t.version, a.* FROM (SELECT * FROM t WHERE regexp_matches(version, '[.-](rhlw|redhat)-[0-9]+')) t JOIN a ON a.package = t.grp || ':' || t.artifact OR a.package = t.artifact OR ends_with(a.package, ':' || t.artifact)),
s AS (SELECT *, row_number() OVER (PARTITION BY artifact, version, cve ORDER BY fixed = version DESC, {KEY.format("fixed")} DESC) AS rn FROM m WHERE fixed = version OR {KEY.format("version")} >= {KEY.format("fixed")})
SELECT artifact, version, cve, fixed, substr(summary, 1, 240) AS summary FROM s WHERE rn = 1""")
def q14_cve_fixed(spark, sf_dir):
    return catalog.fixed_by(values(spark, "grp, artifact, version", TARGETS), values(spark, "cve, package, fixed, summary", ADVISORIES))
