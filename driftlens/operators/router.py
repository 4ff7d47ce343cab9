"""Test routing: selection, attribution, obligations and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Age, in commits, that a coverage map without an age counts as.
UNKNOWN_AGE = 1_000_000


#: What a report says where no test exists at all.
NO_SUITE = "No tests exist: the grade rests on static reachability, and a release to a single instance has to make up for it."


def select_tests(suite: DataFrame, covers: DataFrame, affected: DataFrame, changed_since: DataFrame) -> DataFrame:
    """(test, why) of the tests to run: affected by an upgrade, widened by later changes, or unmapped.

    ``suite`` (test), ``covers`` (test, cls; a mapped test that covers nothing has one row with a null class),
    ``affected`` (cls, reason, at: the upgrade's place in the payload), ``changed_since`` (cls). ``why`` names each
    class hit, in order, with its upgrades in the payload's order.
    """
    listed = F.array_sort(F.collect_list(F.struct("at", "reason")))
    per_class = affected.groupBy("cls").agg(F.array_join(F.transform(listed, lambda x: x["reason"]), " & ").alias("reasons"))
    hits = covers.join(per_class, "cls").select("test", F.struct(F.col("cls").cast("string").alias("cls"), "reasons").alias("h"))
    said = F.transform(F.array_sort(F.collect_set("h")), lambda h: F.concat(F.lit("covers "), h["cls"], F.lit(" <- "), h["reasons"]))
    direct = hits.groupBy("test").agg(F.array_join(said, "; ").alias("why"))
    widened = covers.join(changed_since, "cls", "left_semi").select("test").distinct().withColumn("why", F.lit("changed since the map"))
    unmapped = suite.join(covers.select("test").distinct(), "test", "left_anti").withColumn("why", F.lit("not in the map"))
    first = suite.join(direct, "test")
    second = suite.join(widened.join(direct, "test", "left_anti"), "test")
    return first.unionByName(second).unionByName(unmapped)


def affected_classes(payload: DataFrame) -> DataFrame:
    """(cls, reason, at) of the application classes that the upgrades of a routing payload affect."""
    up = payload.select(F.posexplode("upgrades").alias("at", "u"))
    signed = F.when(F.col("u.confidence.signed_off"), ", signed-off").otherwise("")
    reason = F.concat(F.col("u.library"), F.lit(" "), F.col("u.path"), F.lit(" ["), F.col("u.confidence.evidence"), signed, F.lit("]"))
    return up.select(F.explode("u.affected_app_classes").alias("cls"), reason.alias("reason"), "at")


def route(suite: DataFrame, covers: DataFrame | None, affected: DataFrame, changed_since: DataFrame, full_because: list[str]) -> DataFrame:
    """(test, bucket, why) of every test of the suite: selected, widened or skipped.

    With a reason in ``full_because`` (or no readable map) the whole suite is selected.
    """
    if full_because or covers is None:
        because = "; ".join(full_because) or "no coverage map"
        return suite.select("test", F.lit("selected").alias("bucket"), F.lit(f"whole suite: {because}").alias("why"))
    chosen = select_tests(suite, covers, affected, changed_since)
    bucket = F.when(F.col("why").isNull(), "skipped").when(F.col("why") == "changed since the map", "widened").otherwise("selected")
    return suite.join(chosen, "test", "left").select("test", bucket.alias("bucket"), F.coalesce("why", F.lit("covers no affected class")).alias("why"))


def stages(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The obligations to meet in the build, and those left to later stages."""
    later = F.coalesce(F.col("stage") == "downstream", F.lit(False))
    return entries.where(~later), entries.where(later)


def attribute(failed: DataFrame, tests: DataFrame) -> DataFrame:
    """(name, test): failures matched to tests by class token, or by the test's name and a dot at their beginning.

    A failure meets a test if its class token is the test or the test's own token, or a dotted prefix of it is the test.
    """
    from ..functions.members import test_class_of
    from .hazards import prefixes

    parts = prefixes(F.col("name"))
    proper = F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))
    token = test_class_of(F.col("name"))
    by_name = failed.select("name", F.explode(F.array_distinct(F.concat(F.array(token), proper))).alias("test")).join(tests.select("test"), "test")
    by_token = failed.select("name", token.alias("token")).join(tests.select("test", test_class_of(F.col("test")).alias("token")), "token")
    return by_name.select("name", "test").unionByName(by_token.select("name", "test")).distinct()


# Fixed value: how a selection's reason names a library.
MARKER = "<- {} "


def tests_by_library(entries: DataFrame, libraries: DataFrame, covers: DataFrame | None = None, affected: DataFrame | None = None) -> DataFrame:
    """(library, test): by the libraries that the reasons name; if none names any, by the classes covered and affected.

    ``entries`` (test, reason), ``libraries`` (library), ``covers`` (test, cls), ``affected`` (library, cls). Without
    entries every mapped test counts as selected.
    """
    # what stands between the marker and a space is a candidate, so reasons meet libraries by equality
    named = entries.where("test IS NOT NULL").select("test", F.explode(F.regexp_extract_all(F.coalesce("reason", F.lit("")), F.lit("<- ([^ ]+) "), F.lit(1))).alias("library"))
    by_reason = named.join(libraries, "library").select("library", "test").distinct()
    if covers is None or affected is None or not by_reason.isEmpty():
        return by_reason
    chosen = entries.where("test IS NOT NULL").select("test").distinct()
    mapped = covers if chosen.isEmpty() else covers.join(chosen, "test", "left_semi")
    return mapped.join(affected.join(libraries, "library", "left_semi"), "cls").select("library", "test").distinct()


def results_by_library(by_library: DataFrame, libraries: DataFrame, failed: DataFrame, ran: bool, methods_failed: int) -> DataFrame:
    """library, selected_tests, selected_count, status and failed_names of every library."""
    met = attribute(failed, by_library.select("test").distinct())
    fails = by_library.join(met, "test").groupBy("library").agg(F.array_sort(F.collect_set("name")).alias("failed_names"))
    tests = by_library.groupBy("library").agg(F.array_sort(F.collect_set("test")).alias("selected_tests"))
    none = F.array().cast("array<string>")
    rows = libraries.select("library").distinct().join(tests, "library", "left").join(fails, "library", "left")
    rows = rows.select("library", F.coalesce("selected_tests", none).alias("selected_tests"), F.coalesce("failed_names", none).alias("failed_names"))
    aggregate = F.lit(methods_failed > 0 and failed.isEmpty())
    hit = F.when(F.lit(methods_failed > 0), F.size("failed_names")).otherwise(0)
    return rows.select("library", "selected_tests", F.size("selected_tests").alias("selected_count"), status(F.lit(ran), F.size("selected_tests"), hit, aggregate).alias("status"), "failed_names")


def obligations(entries: DataFrame, tagged: DataFrame) -> DataFrame:
    """(id, resolved, ok): how many tests each obligation's tag resolves to, and whether that is enough."""
    counted = tagged.groupBy("tag").agg(F.countDistinct("test").alias("n"))
    resolved = F.coalesce("n", F.lit(0)).cast("long")
    return entries.join(counted, "tag", "left").select("id", resolved.alias("resolved"), (resolved >= F.col("min_resolved")).alias("ok"))


def mode(suite: Column, resolved_ok: Column, shrink_allowed: Column, readable: Column, age: Column, most_age: int = 25) -> Column:
    """The routing mode of one payload."""
    full = ~shrink_allowed | ~readable | (F.coalesce(age, F.lit(UNKNOWN_AGE)) > most_age)
    return F.when(suite == 0, "REACHABILITY_ONLY").when(~resolved_ok, "STALE_OBLIGATION").when(full, "FULL").otherwise("TARGETED")


def status(ran: Column, selected: Column, failed: Column, aggregate_failure: Column) -> Column:
    """A library's test status."""
    return F.when(~ran, "not_run").when(selected == 0, "not_selected").when((failed > 0) | aggregate_failure, "failed").otherwise("passed")


def cab_decision(grade: Column) -> Column:
    return F.when(grade.isin("A", "B"), "auto").when(grade.isin("C", "D", "F"), "human").otherwise("fail")
