"""Catalog coverage and advisory joins: version comparisons as equi joins with a residual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.versions import base_version, is_remediated, satisfies, version_key


def bucket(components: DataFrame, catalog: DataFrame) -> DataFrame:
    """(grp, artifact, version, bucket, full_version, serviced): exact, near or uncovered for every component.

    ``serviced`` holds the builds of the same or later base versions of a near component, in version order.
    ``catalog``: grp (null matches any group), artifact, base_version, full_version; one row a base.
    """
    mine = components.select("grp", "artifact", "version")
    exact_group = catalog.select(F.col("grp").alias("c_grp"), F.col("artifact").alias("c_artifact"), "base_version", "full_version")
    keyed = exact_group.groupBy("c_grp", "c_artifact").agg(F.collect_list(F.struct("base_version", "full_version")).alias("bases"))
    own = keyed.where("c_grp IS NOT NULL").withColumnRenamed("bases", "own")
    any_group = keyed.where("c_grp IS NULL").select(F.col("c_artifact").alias("a_artifact"), F.col("bases").alias("any"))
    found = mine.join(own, (F.col("grp") == F.col("c_grp")) & (F.col("artifact") == F.col("c_artifact")), "left").join(any_group, F.col("artifact") == F.col("a_artifact"), "left")
    found = found.withColumn("bases", F.coalesce("own", "any"))
    equal = F.get(F.filter("bases", lambda b: b["base_version"] == F.col("version")), F.lit(0))["full_version"]
    adopted = F.get(F.filter("bases", lambda b: b["full_version"] == F.col("version")), F.lit(0))["full_version"]
    later = F.exists("bases", lambda b: version_key(b["base_version"]) >= version_key(base_version(F.col("version"))))
    kind = F.when(F.coalesce(equal, adopted).isNotNull(), "exact").when(later, "near").otherwise("uncovered")
    forward = F.filter("bases", lambda b: version_key(b["base_version"]) >= version_key(base_version(F.col("version"))))
    ordered = F.transform(F.array_sort(F.transform(forward, lambda b: F.struct(version_key(b["base_version"]).alias("k"), b["full_version"].alias("f")))), lambda x: x["f"])
    done = found.select("grp", "artifact", "version", kind.alias("bucket"), F.coalesce(equal, adopted).alias("full_version"), ordered.alias("forward"))
    return done.select("grp", "artifact", "version", "bucket", "full_version", F.when(F.col("bucket") == "near", F.col("forward")).alias("serviced"))


def totals(bucketed: DataFrame) -> DataFrame:
    """One row: dependencies, exact, serviced_other_version, uncovered, and the share of exact ones in whole percent (half to even)."""
    of = lambda kind: F.count_if(F.col("bucket") == kind)
    counted = bucketed.agg(F.count("*").alias("dependencies"), of("exact").alias("exact"), of("near").alias("serviced_other_version"), of("uncovered").alias("uncovered"))
    return counted.withColumn("exact_pct", F.coalesce(F.try_divide(100.0 * F.col("exact"), F.col("dependencies")), F.lit(0.0))).withColumn("exact_pct", F.bround("exact_pct", 0).cast("int"))


def mark_changes(bucketed: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows with in_this_change, those of this change first, then by group and artifact (nulls first)."""
    keys = changes.select(F.coalesce("grp", F.lit("")).alias("grp_key"), "artifact").distinct().withColumn("in_this_change", F.lit(True))
    marked = bucketed.withColumn("grp_key", F.coalesce("grp", F.lit(""))).join(keys, ["grp_key", "artifact"], "left").drop("grp_key")
    return marked.withColumn("in_this_change", F.coalesce("in_this_change", F.lit(False))).orderBy(F.desc("in_this_change"), F.asc_nulls_first("grp"), "artifact", "version")


def freshness(catalog: DataFrame, latest: DataFrame) -> DataFrame:
    """(grp, artifact, full_version, latest, state): SAME, DIFFERS or NOT_FOUND against published metadata (grp, artifact, latest)."""
    state = F.when(F.col("latest").isNull(), "NOT_FOUND").when(F.col("latest") == F.col("full_version"), "SAME").otherwise("DIFFERS")
    return catalog.join(latest.select("grp", "artifact", "latest"), ["grp", "artifact"], "left").select("grp", "artifact", "full_version", "latest", state.alias("state"))


def fixed_by(targets: DataFrame, advisories: DataFrame) -> DataFrame:
    """(artifact, version, cve, fixed, summary): advisories that each remediated target version fixes; other targets fix none.

    ``advisories``: cve, package, fixed, summary. A package names the artifact alone or after a
    colon, so the artifact is an equi key. Of several fixes of a CVE the one equal to the target
    wins, else the highest.
    """
    keyed = advisories.withColumn("artifact", F.substring_index("package", ":", -1))
    met = targets.where(is_remediated(F.col("version"))).select("grp", "artifact", "version").join(keyed, "artifact")
    named = (F.col("package") == F.concat_ws(":", "grp", "artifact")) | (F.col("package") == F.col("artifact")) | F.col("package").endswith(F.concat(F.lit(":"), F.col("artifact")))
    met = met.where(named & satisfies(F.col("version"), F.col("fixed")))
    best = F.max_by(F.struct("fixed", "summary"), F.struct(F.col("fixed") == F.col("version"), version_key(F.col("fixed"))))
    return met.groupBy("artifact", "version", "cve").agg(best.alias("b")).select("artifact", "version", "cve", F.col("b.fixed").alias("fixed"), F.substring("b.summary", 1, 240).alias("summary"))
