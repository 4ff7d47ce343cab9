"""Project files as tables: build descriptions, test sources and test reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import is_remediated
from ..operators.diff import three_way

# How a test source declares a tag, and the tag that the short form stands for.
TAG = r'@Tag\(\s*"([^"]+)"\s*\)'
GATE_ANNOTATION, GATE_TAG = r"@UpgradeGate\b", "upgrade-gate"
REPORT_TOTALS = r"Tests run:\s*(\d+),\s*Failures:\s*(\d+),\s*Errors:\s*(\d+)"

def _tag(name: str, inner: str = ".*?") -> str:
    """A pattern for an element of that local name, whatever its prefix; its content is group 1."""
    return rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>({inner})</(?:\w+:)?{name}\s*>"


def _without(text, *names: str):
    for name in names:
        text = F.regexp_replace(text, _tag(name), "")
    return text


def poms(spark: SparkSession, path: str) -> DataFrame:
    """path and text of build descriptions."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pom_dependencies(files: DataFrame, managed: bool = True) -> DataFrame:
    """path, grp, artifact, version and at of each dependency that names all three; with ``managed`` also the managed ones.

    Namespaces are ignored; dependencies of plugins and profiles, and exclusions, are not the project's. A version
    ``${name}`` takes the document's own property; one that the document does not define stays as it is
    (see ``is_unresolved``).
    """
    project = _without(F.regexp_replace("text", r"(?s)<!--.*?-->", ""), "build", "profiles", "reporting", "exclusions")
    management = F.regexp_extract(project, _tag("dependencyManagement"), 1)
    plain = _without(project, "dependencyManagement")
    block = F.regexp_extract(plain, _tag("properties"), 1)
    pair = r"<(?:\w+:)?([\w.-]+)>([^<]*)</"
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    properties = F.zip_with(F.regexp_extract_all(block, F.lit(pair), F.lit(1)), F.regexp_extract_all(block, F.lit(pair), F.lit(2)), lambda k, v: F.named_struct(F.lit("k"), k, F.lit("v"), trimmed(v)))
    properties = F.filter(properties, lambda p: F.length(p["v"]) > 0)
    inside = lambda x: F.regexp_extract_all(F.regexp_extract(x, _tag("dependencies"), 1), F.lit(_tag("dependency")), F.lit(1))
    listed = F.concat(inside(plain), inside(management)) if managed else inside(plain)
    rows = files.select("path", properties.alias("properties"), F.posexplode(listed).alias("at", "d"))
    field = lambda name: trimmed(F.regexp_extract("d", _tag(name, "[^<]*"), 1))
    rows = rows.select("path", "properties", "at", field("groupId").alias("grp"), field("artifactId").alias("artifact"), field("version").alias("raw")).where("grp <> '' AND artifact <> '' AND raw <> ''")
    name = F.regexp_extract("raw", r"^\$\{([\w.-]+)\}$", 1)
    own = F.filter("properties", lambda p: p["k"] == name)
    return rows.select("path", "grp", "artifact", F.when((name != "") & (F.size(own) > 0), F.try_element_at(own, F.lit(-1))["v"]).otherwise(F.col("raw")).alias("version"), "at")


def is_unresolved(version):
    return version.startswith("${")


def pom_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """grp, artifact, old_version, new_version, change (changed, added, removed) and adopted, between two sides' dependencies.

    Of entries of one artifact the last counts; versions that are not resolved say nothing, so their rows are left out.
    """
    keys = ["grp", "artifact"]
    last = lambda d: d.groupBy(*keys).agg(F.max_by("version", "at").alias("version"))
    met = three_way(last(base), last(head), keys, "version").where("status <> 'same'")
    known = ~F.coalesce(is_unresolved(F.col("old_value")), F.lit(False)) & ~F.coalesce(is_unresolved(F.col("new_value")), F.lit(False))
    adopted = (F.col("status") == "changed") & F.coalesce(F.col("new_value").rlike(r"[.-](rhlw|redhat)-\d+$"), F.lit(False))
    return met.where(known).select(*keys, F.col("old_value").alias("old_version"), F.col("new_value").alias("new_version"), F.col("status").alias("change"), adopted.alias("adopted"))


def primary_change(changes: DataFrame) -> DataFrame:
    """The one change to follow up: an adoption if there is any, else a change, the first by group and artifact."""
    return changes.where("change = 'changed'").orderBy(F.desc("adopted"), "grp", "artifact").limit(1)


def tree_changes(old: DataFrame, new: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """grp, artifact, old_version and new_version of artifacts in both trees whose versions differ, but for ``excluded`` (grp, artifact)."""
    keys = ["grp", "artifact"]
    met = old.withColumnRenamed("version", "old_version").join(new.withColumnRenamed("version", "new_version"), keys).where("old_version <> new_version")
    return met if excluded is None else met.join(excluded.select(*keys), keys, "left_anti")


def pom_components(dependencies: DataFrame) -> DataFrame:
    """grp, artifact and version of direct dependencies whose version is known: the rows of a bill of materials."""
    return dependencies.where(~is_unresolved(F.col("version"))).select("grp", "artifact", "version", is_remediated(F.col("version")).alias("remediated"))


def test_sources(spark: SparkSession, path: str) -> DataFrame:
    """test (the file's stem) and text of every Java file below ``path``."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").text(path, wholetext=True)
    return read.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.java$", 1).alias("test"), F.col("value").alias("text"))


def tagged_tests(sources: DataFrame) -> DataFrame:
    """tag and test of every tag that a test source declares."""
    short = F.when(F.col("text").rlike(GATE_ANNOTATION), F.array(F.lit(GATE_TAG))).otherwise(F.array().cast("array<string>"))
    return sources.select("test", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(TAG), F.lit(1)), short))).alias("tag")).distinct()


def report_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: reports, run, failed and passed, summed over the text reports below ``path`` (the first totals line of each)."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    n = lambda i: F.regexp_extract("value", REPORT_TOTALS, i).try_cast("long")
    rows = read.select(n(1).alias("run"), n(2).alias("failures"), n(3).alias("errors"))
    sums = rows.agg(F.count("*").alias("reports"), F.coalesce(F.sum("run"), F.lit(0)).alias("run"), F.coalesce(F.sum(F.col("failures") + F.col("errors")), F.lit(0)).alias("failed"))
    return sums.withColumn("passed", F.col("run") - F.col("failed"))


def failed_names(spark: SparkSession, path: str) -> DataFrame:
    """name (Class.method) of every test case with a failure or error in the XML reports below ``path``."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "TEST-*.xml").text(path, wholetext=True)
    cases = read.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<testcase\b(?:[^>]*/>|.*?</testcase>))"), F.lit(1))).alias("c"))
    bad = cases.where(F.col("c").rlike(r"<(failure|error)\b"))
    field = lambda name: F.regexp_extract("c", rf'^<testcase\b[^>]*?\s{name}="([^"]+)"', 1)
    return bad.select(F.concat(F.regexp_extract(field("classname"), r"([^.]*)$", 1), F.lit("."), field("name")).alias("name")).distinct()


def runner_log(spark: SparkSession, path: str) -> DataFrame:
    """outcome (PASS or FAIL) and name of the lines of a plain runner's log; what follows an arrow is the message."""
    line = r"^\s*(PASS|FAIL)\s+(.*)$"
    name = F.replace(F.trim(F.regexp_replace(F.regexp_extract("value", line, 2), r"\s*->.*", "")), F.lit("#"), F.lit("."))
    return spark.read.text(path).where(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).alias("outcome"), name.alias("name"))
