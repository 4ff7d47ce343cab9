"""Dependency, catalogue, advisory and coverage documents as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import SUFFIX, base_version
from ..operators.diff import last_wins

COMPONENTS = "array<struct<type: string, group: string, name: string, version: string, purl: string>>"
SBOM = f"metadata struct<component: struct<type: string, name: string, version: string>>, components {COMPONENTS}, dependencies array<struct<ref: string, dependsOn: array<string>>>"
ADVISORY = "id string, summary string, details string, aliases array<string>, affected array<struct<package: struct<ecosystem: string, name: string>, ranges array<struct<type: string, events: array<struct<introduced: string, fixed: string>>>>>>".replace("ranges array", "ranges: array")
COVERAGE = "collected_at_sha string, build string, age_commits bigint, tests map<string, struct<covers: array<string>>>"
# Fixed value: a line of a dependency listing, behind its drawing: group, artifact, packaging, perhaps a classifier, version, scope.
TREE_LINE = r"^(?:\[\w+\])?[\s|+\\`-]*([\w.\-]+):([\w.\-]+):[\w.\-]+(?::[\w.\-]+)?:([\w.\-]+):\w+"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def sbom_components(spark: SparkSession, path: str) -> DataFrame:
    """grp, artifact, version and purl of the named library components; the group falls back to the purl."""
    c = _json(spark, path, SBOM).select(F.explode("components").alias("c")).select("c.*")
    libraries = c.where((F.col("type").isNull() | (F.col("type") == "library")) & (F.length("name") > 0) & (F.length("version") > 0))
    from_purl = F.regexp_extract("purl", r"^pkg:[^/]+/([^/@]+)/", 1)
    group = F.when(F.length("group") > 0, F.col("group")).when(F.length(from_purl) > 0, from_purl)
    return libraries.select(group.alias("grp"), F.col("name").alias("artifact"), "version", "purl")


def sbom_edges(spark: SparkSession, path: str) -> DataFrame:
    """parent, child, at and is_root of every dependency edge, in document order; a name is what stands before its version.

    A package URL is reduced to its artifact; ``is_root`` marks edges of the document's own component.
    """
    d = _json(spark, path, SBOM).select(F.col("metadata.component.name").alias("root"), F.posexplode("dependencies").alias("at", "d"))
    name = lambda ref: F.split_part(F.regexp_replace(ref, r"^pkg:[^/]+/(?:[^/@]+/)?", ""), F.lit("@"), F.lit(1))
    edges = d.select("root", name(F.col("d.ref")).alias("parent"), "at", F.posexplode("d.dependsOn").alias("inner", "ref"))
    return edges.select("parent", name(F.col("ref")).alias("child"), F.struct("at", "inner").alias("at"), F.coalesce(F.col("parent") == F.col("root"), F.lit(False)).alias("is_root"))


def parents(edges: DataFrame) -> DataFrame:
    """child and parent: the last edge that does not start at the document's own component."""
    return edges.where("NOT is_root").groupBy("child").agg(F.max_by("parent", "at").alias("parent"))


def catalog(spark: SparkSession, path: str, suffix: str = SUFFIX) -> DataFrame:
    """grp, artifact, base_version and full_version; of entries with one base the last one counts."""
    rows = _json(spark, path, SBOM).select(F.posexplode("components").alias("at", "c"))
    rows = rows.select(F.col("c.group").alias("grp"), F.col("c.name").alias("artifact"), base_version(F.col("c.version"), suffix).alias("base_version"), F.col("c.version").alias("full_version"), "at")
    return last_wins(rows, ["grp", "artifact", "base_version"], ["at"]).select("grp", "artifact", "base_version", "full_version")


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """id, cve, package, fixed and summary of every fix event; documents without packages or fixes go.

    Hidden files are not read; a document without a summary is described by its details.
    """
    docs = _json(spark, path, ADVISORY).where(F.size("affected") > 0)
    told = F.coalesce(F.when(F.length("summary") > 0, F.col("summary")), "details")
    events = docs.select("id", told.alias("summary"), F.filter("aliases", lambda a: a.startswith("CVE-")).alias("cves"), F.explode("affected").alias("a"))
    events = events.select("id", "summary", F.explode("cves").alias("cve"), F.col("a.package.name").alias("package"), F.explode("a.ranges").alias("r"))
    return events.select("id", "cve", "package", F.explode("r.events").alias("e"), "summary").where("e.fixed IS NOT NULL").select("id", "cve", "package", F.col("e.fixed").alias("fixed"), "summary").distinct()


def coverage_map(spark: SparkSession, path: str) -> DataFrame:
    """test, cls, build and age_commits: one row for every class a test covers, and one with a null class for a test that covers none."""
    m = _json(spark, path, COVERAGE).select("build", "age_commits", F.explode("tests").alias("test", "t"))
    return m.select("test", F.explode_outer("t.covers").alias("cls"), "build", "age_commits")


def coverage_provenance(spark: SparkSession, path: str) -> DataFrame:
    """build, sha and age_commits of the map; no row where the document is not one."""
    return _json(spark, path, COVERAGE).where("tests IS NOT NULL").select("build", F.col("collected_at_sha").alias("sha"), "age_commits")


def dependency_tree(spark: SparkSession, path: str) -> DataFrame:
    """grp, artifact and version of each artifact of a dependency tree listing; the last line of an artifact counts."""
    part = lambda i: F.regexp_extract("value", TREE_LINE, i)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    return last_wins(lines.where(F.col("value").rlike(TREE_LINE)).select(part(1).alias("grp"), part(2).alias("artifact"), part(3).alias("version"), "at"), ["grp", "artifact"], ["at"]).select("grp", "artifact", "version")


CHANGE = "group string, groupId string, artifact string, artifactId string, old_version string, fromVersion string, new_version string, toVersion string"


def change_list(spark: SparkSession, path: str) -> DataFrame:
    """grp, artifact, old_version and new_version of the changes of a proposal: an object with changed and added, or a plain list.

    Either spelling of the fields will do; entries without an artifact go, absent versions are empty.
    """
    text = spark.read.text(path, wholetext=True)
    kind = f"array<struct<{CHANGE.replace(' string', ': string')}>>"
    both = F.from_json("value", f"changed {kind}, added {kind}")
    none = F.array().cast(kind)
    entries = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(F.concat(F.coalesce(both["changed"], none), F.coalesce(both["added"], none)))
    rows = text.select(F.explode(entries).alias("c")).select("c.*")
    first = lambda *names: F.coalesce(*(F.when(F.length(n) > 0, F.col(n)) for n in names), F.lit(""))
    return rows.select(first("group", "groupId").alias("grp"), first("artifact", "artifactId").alias("artifact"), first("old_version", "fromVersion").alias("old_version"), first("new_version", "toVersion").alias("new_version")).where("artifact <> ''")


KEYS = "array<array<string>>"
MACHINE = f"struct<packages: array<string>, api_removed: {KEYS}, api_added: {KEYS}, api_modified: {KEYS}, api_incompatible: {KEYS}, classes_impl_changed: array<string>, classes_build_noise: array<string>, classes_common: bigint, impl_churn_pct: double, res_removed: array<string>, res_added: array<string>, res_changed: array<string>, spi_touched: array<string>>"


def evidence(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """pair (the file's path), library, old_version, new_version, stream and machine of published evidence documents.

    Takes files and folders of ``*.json``; documents without a machine section are left out.
    """
    read = spark.read.schema(f"library string, old_version string, new_version string, stream string, machine {MACHINE}").option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return read.where("machine IS NOT NULL").select(F.col("_metadata.file_path").alias("pair"), "library", "old_version", "new_version", "stream", "machine")


ROUTING = "schema string, app string, project_grade string, shrink_allowed boolean, upgrades array<struct<library: string, path: string, lane: string, grade: string, effective_grade: string, transitive: boolean, parent: string, affected_app_classes: array<string>, affected_app_classes_changed: array<string>, confidence: struct<evidence: string, signed_off: boolean>>>, obligations array<struct<id: string, stage: string, declaration: struct<type: string, value: string, classes: array<string>>, min_resolved: int, note: string>>"


def routing(spark: SparkSession, path: str) -> DataFrame:
    """A routing payload as one row."""
    return _json(spark, path, ROUTING)


def coverage_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of an earlier catalogue coverage document; absent numbers are 0, an unreadable document gives no row."""
    rows = _json(spark, path, "totals struct<dependencies: bigint, exact: bigint, serviced_other_version: bigint, uncovered: bigint>")
    return rows.where("totals IS NOT NULL").select("totals.*").na.fill(0)
