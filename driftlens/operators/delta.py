"""Deltas of library pairs: members, classes, resources, and the evidence document, for any number of pairs at once.

``pairs`` holds pair, library, old_version, new_version, old_path and new_path; ``entries`` is what
``sources.archives`` reads. Old and new sides meet by one aggregation on their key, in which null name
and description (the class itself) are values like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.members import api_bits, narrowed, package_of
from ..functions.versions import classify_stream
from ..sources.archives import api_members
from .grading import rate

MEMBER = ["cls", "name", "desc"]


def sides(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of both sides of each pair, with pair and is_new in place of path."""
    either = pairs.select("pair", F.explode(F.array(F.struct(F.col("old_path").alias("path"), F.lit(False).alias("is_new")), F.struct(F.col("new_path").alias("path"), F.lit(True).alias("is_new")))).alias("s"))
    return table.join(either.select("pair", "s.path", "s.is_new"), "path").drop("path")


def _met(both: DataFrame, keys: list[str], value: str) -> DataFrame:
    """pair, keys, old and new value, and whether each side has the key; of entries that clash the last counts."""
    has_order = "at" in both.columns
    pick = lambda new: (F.max_by(F.when(F.col("is_new") == new, F.col(value)), F.when(F.col("is_new") == new, F.col("at"))) if has_order else F.max(F.when(F.col("is_new") == new, F.col(value))))
    return both.groupBy("pair", *keys).agg(pick(False).alias("old"), pick(True).alias("new"), F.bool_or(~F.col("is_new")).alias("in_old"), F.bool_or("is_new").alias("in_new"))


def member_changes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pair, cls, name, desc, change (removed, added, modified) and incompatible."""
    met = _met(sides(members.select("path", *MEMBER, "access"), pairs), MEMBER, "access")
    change = F.when(~F.col("in_new"), "removed").when(~F.col("in_old"), "added").when(api_bits(F.col("old")) != api_bits(F.col("new")), "modified")
    rows = met.withColumn("change", change).where("change IS NOT NULL")
    broken = (F.col("change") == "removed") | ((F.col("change") == "modified") & narrowed(F.col("old"), F.col("new")))
    return rows.select("pair", *MEMBER, "change", broken.alias("incompatible"))


def class_changes(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """pair, cls and status (changed, noise, same) of every class that both sides have."""
    classes = entries.where("kind = 'class'").select("path", "cls", F.struct("sha256", "fingerprint").alias("content"))
    met = _met(sides(classes, pairs), ["cls"], "content").where("in_old AND in_new")
    status = F.when(F.col("old.sha256") == F.col("new.sha256"), "same").when(F.col("old.fingerprint") == F.col("new.fingerprint"), "noise").otherwise("changed")
    return met.select("pair", "cls", status.alias("status"))


def resource_changes(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """pair, entry and change (removed, added, changed) of every resource that differs."""
    met = _met(sides(entries.where("kind = 'resource'").select("path", "entry", "sha256"), pairs), ["entry"], "sha256")
    change = F.when(~F.col("in_new"), "removed").when(~F.col("in_old"), "added").when(F.col("old") != F.col("new"), "changed")
    return met.select("pair", "entry", change.alias("change")).where("change IS NOT NULL")


def is_behaviour(entry: Column) -> Column:
    """Resources that can change behaviour: all but the manifest."""
    return ~entry.startswith("META-INF/MANIFEST")


def is_service(entry: Column) -> Column:
    """Service registrations."""
    return entry.startswith("META-INF/services/")


def packages(entries: DataFrame) -> DataFrame:
    """path and package of every package that holds a class; the default package is left out."""
    return entries.where("kind = 'class'").select("path", package_of(F.col("cls")).alias("package")).where("package <> ''").distinct()


def _keys(condition: Column) -> Column:
    """The member keys that meet the condition as arrays [cls, name, desc], sorted with nulls as empty text."""
    key = F.struct(F.col("cls").alias("a"), F.coalesce("name", F.lit("")).alias("b"), F.coalesce("desc", F.lit("")).alias("c"), F.array("cls", "name", "desc").alias("k"))
    return F.transform(F.array_sort(F.collect_list(F.when(condition, key))), lambda x: x["k"])


def _names(column: str, condition: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(condition, F.col(column))))


def evidence(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """One row a pair: library, versions, stream, the machine section, counts and the rating without any use."""
    change, status = F.col("change"), F.col("status")
    members = member_changes(pairs, api_members(entries)).groupBy("pair").agg(
        _keys(change == "removed").alias("api_removed"), _keys(change == "added").alias("api_added"), _keys(change == "modified").alias("api_modified"), _keys(F.col("incompatible")).alias("api_incompatible")
    )
    classes = class_changes(pairs, entries).groupBy("pair").agg(_names("cls", status == "changed").alias("classes_impl_changed"), _names("cls", status == "noise").alias("classes_build_noise"), F.count("*").alias("classes_common"))
    res = resource_changes(pairs, entries).groupBy("pair").agg(
        _names("entry", change == "removed").alias("res_removed"), _names("entry", change == "added").alias("res_added"), _names("entry", change == "changed").alias("res_changed"), _names("entry", is_service(F.col("entry"))).alias("spi_touched")
    )
    held = pairs.select("pair", F.col("old_path").alias("path")).join(packages(entries), "path").groupBy("pair").agg(F.array_sort(F.collect_set("package")).alias("packages"))
    rows = pairs.drop("old_path", "new_path")
    for part in (held, members, classes, res):
        rows = rows.join(part, "pair", "left")
    lists = ["packages", "classes_impl_changed", "classes_build_noise", "res_removed", "res_added", "res_changed", "spi_touched"]
    keyed = ["api_removed", "api_added", "api_modified", "api_incompatible"]
    rows = rows.select(
        *pairs.drop("old_path", "new_path").columns,
        *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists),
        *(F.coalesce(c, F.array().cast("array<array<string>>")).alias(c) for c in keyed),
        F.coalesce("classes_common", F.lit(0)).alias("classes_common"),
    )
    churn = F.when(F.col("classes_common") == 0, F.lit(0.0)).otherwise(F.round(100.0 * F.size("classes_impl_changed") / F.col("classes_common"), 1))
    rows = rows.withColumn("impl_churn_pct", churn).withColumn("stream", classify_stream(F.col("old_version"), F.col("new_version")))
    machine = F.struct("packages", *keyed, "classes_impl_changed", "classes_build_noise", "classes_common", "impl_churn_pct", "res_removed", "res_added", "res_changed", "spi_touched")
    nested = rows.select(*pairs.drop("old_path", "new_path").columns, "stream", machine.alias("machine"))
    return rate(nested.select("*", *machine_counts()))


def machine_counts(machine: str = "machine") -> list[Column]:
    """The counts that the rating rules read, from a machine section."""
    n = lambda name: F.size(f"{machine}.{name}").cast("long").alias(name.removeprefix("api_"))
    behaviour = F.filter(F.concat(f"{machine}.res_changed", f"{machine}.res_added", f"{machine}.res_removed"), is_behaviour)
    return [n("api_incompatible"), n("api_modified"), n("api_added"), n("api_removed"), F.col(f"{machine}.impl_churn_pct").alias("churn"), F.size(behaviour).cast("long").alias("resources"), F.size(f"{machine}.spi_touched").cast("long").alias("spi")]


def unpack(published: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """packages (pair, package), changes (pair, cls, name, desc, change, incompatible) and classes (pair, cls, status) of
    published evidence: all that a consumer needs to judge an application without the archives."""
    rows = published.select("pair", "machine.*")
    held = rows.select("pair", F.explode("packages").alias("package")).distinct()
    kinds = {"api_removed": "removed", "api_added": "added", "api_modified": "modified", "api_incompatible": None}
    parts = [rows.select("pair", F.explode(c).alias("k"), F.lit(v).cast("string").alias("change"), F.lit(c == "api_incompatible").alias("incompatible")) for c, v in kinds.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    keyed = every.select("pair", *(F.get("k", F.lit(i)).alias(c) for i, c in enumerate(MEMBER)), "change", "incompatible")
    changes = keyed.groupBy("pair", *MEMBER).agg(F.max("change").alias("change"), F.bool_or("incompatible").alias("incompatible"))
    states = [rows.select("pair", F.explode(c).alias("cls"), F.lit(v).alias("status")) for c, v in (("classes_impl_changed", "changed"), ("classes_build_noise", "noise"))]
    return held, changes, states[0].unionByName(states[1]).distinct()
