"""The upgrade grading rules and rollups as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grades from best to worst.
GRADES = ("A", "B", "C", "D", "F")
#: The test lane of each grade, and what to do in it.
LANES = {
    "A": ("Smoke check", ["Start the service and check that it answers", "Release to a single instance", "Release to all once its error rate is steady"]),
    "B": ("Test the callers", ["Start the service and check that it answers", "Run the tests of the code that calls the library", "Look again at settings that were left at their defaults", "Release to a single instance, then to all"]),
    "C": ("Test the modules", ["Run all tests of the modules that use the library", "Start the service as in production", "Check what other systems rely on", "Release to a single instance, then to all"]),
    "D": ("Test everything", ["Run the whole regression suite", "Start the service as in production", "Run integration tests along every path to the library", "Release to a single instance, then to all"]),
    "F": ("Change the code", ["Adapt the code to the members that are gone", "Run the whole regression suite", "Start the service as in production", "Watch a single instance for a long while"]),
}
#: Grades whose lanes permit a smaller set of tests.
SHRINKABLE = ("A", "B")


def rank(grade: Column) -> Column:
    expr = F.lit(None).cast("int")
    for i, g in reversed(list(enumerate(GRADES))):
        expr = F.when(grade == g, i).otherwise(expr)
    return expr


def unrank(r: Column) -> Column:
    return F.get(F.array(*map(F.lit, GRADES)), r)


def breaches(grade: Column, fail_on: str | None) -> Column:
    """Whether a grade is as bad as ``fail_on`` or worse; nothing breaches an empty or unknown limit, nor does an unknown grade."""
    if fail_on not in GRADES:
        return F.lit(False)
    return F.coalesce(rank(grade) >= GRADES.index(fail_on), F.lit(False))


def lane(grade: Column) -> Column:
    """The lane's name."""
    return F.create_map(*(F.lit(x) for g, (name, _) in LANES.items() for x in (g, name)))[grade]


def recipe(grade: Column) -> Column:
    """The lane's steps, in order."""
    expr = F.lit(None).cast("array<string>")
    for g, (_, steps) in LANES.items():
        expr = F.when(grade == g, F.array(*map(F.lit, steps))).otherwise(expr)
    return expr


def base_grade(stream: Column, incompatible: Column, modified: Column, added: Column, churn: Column, resources: Column, spi: Column) -> Column:
    """Grade by what changed, before any use is known."""
    z = F.when((incompatible > 0) | (modified > 0), "D").when((added > 0) | (churn >= 10) | (resources > 0) | (spi > 0), "B").otherwise("A")
    return F.when(stream == "z", z).when(stream == "y", F.when(incompatible > 0, "D").otherwise("C")).otherwise("D")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def grade_with_use(base: Column, touches_incompatible: Column, touches_changed: Column, transitive: Column, chain_incompatible: Column, chain_changed: Column) -> Column:
    """The grade once the application's use is known (nulls in the use columns count as false)."""
    chained = F.when(~_yes(transitive) & _yes(chain_incompatible), "F").when(~_yes(transitive) & _yes(chain_changed) & (base == "A"), "B").otherwise(base)
    return F.when(_yes(touches_incompatible), "F").when(_yes(touches_changed), base).otherwise(chained)


def effective_grade(grade: Column, touches: Column, transitive: Column, signoff: Column) -> Column:
    """B for a transitive C or D that is signed off and that the application does not touch; else null."""
    return F.when(grade.isin("C", "D") & _yes(transitive) & _yes(signoff) & ~_yes(touches), "B")


def rate(facts: DataFrame) -> DataFrame:
    """The facts with grade, effective_grade, lane, recipe, reasons and scope_note.

    Facts: stream, incompatible, modified, added, churn, resources, spi; and, where use is known, used (else all of these
    count as unknown), n_touched_incompatible, n_touched_changed, n_chain_incompatible, n_chain_changed, transitive, signoff.
    """
    c = lambda name, kind="long": F.col(name) if name in facts.columns else F.lit(None).cast(kind)
    n = lambda name: F.coalesce(c(name), F.lit(0))
    used, transitive, signoff = (_yes(c(x, "boolean")) for x in ("used", "transitive", "signoff"))
    broken, touched = used & (n("n_touched_incompatible") > 0), used & (n("n_touched_changed") > 0)
    clear = used & ~broken & ~touched
    chain_broken, chain_changed = clear & ~transitive & (n("n_chain_incompatible") > 0), clear & ~transitive & (n("n_chain_changed") > 0)
    base = base_grade(c("stream"), n("incompatible"), n("modified"), n("added"), F.coalesce(c("churn", "double"), F.lit(0.0)), n("resources"), n("spi"))
    graded = grade_with_use(base, broken, touched, transitive, chain_broken, chain_changed)
    z, y, quiet = c("stream", "string") == "z", c("stream", "string") == "y", (n("incompatible") == 0) & (n("modified") == 0)
    say = lambda condition, *parts: F.when(condition, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    text = lambda x: x.cast("string")
    hop = F.when(transitive, " through the parent").otherwise(" itself")
    reasons = F.array_compact(F.array(
        say(z, "patch release: a repair, no new function"),
        say(z & ~quiet, "yet ", text(F.when(n("incompatible") > 0, n("incompatible")).otherwise(n("modified"))), " change(s) of the interface, which a patch should not bring"),
        say(z & quiet & (n("added") > 0), text(n("added")), " new public member(s)"),
        say(z & quiet & (c("churn", "double") >= 10), "implementation changed by ", text(c("churn", "double")), " %, more than a small repair"),
        say(z & quiet & (n("resources") > 0), text(n("resources")), " bundled resource(s) changed, which can alter behaviour alone"),
        say(z & quiet & (n("spi") > 0), "service registrations changed"),
        say(z & (base == "A"), "no change of interface or resources; implementation changed by ", text(F.coalesce(c("churn", "double"), F.lit(0.0))), " %"),
        say(y, "minor release: new function is to be expected"),
        say(~z & ~y, "major or unknown release: a migration"),
        say(~z & (n("incompatible") > 0), text(n("incompatible")), " incompatible change(s)"),
        say(broken, "the application reaches ", text(n("n_touched_incompatible")), " removed or incompatible member(s)", hop, " and will break"),
        say(~broken & touched, "the application reaches ", text(n("n_touched_changed")), " changed member(s)", hop),
        say(clear, "the application reaches no changed member", hop),
        say(chain_broken, "but calls inside the library lead from its entry points to ", text(n("n_chain_incompatible")), " removed or incompatible member(s)"),
        say(~chain_broken & chain_changed, "calls inside the library lead from its entry points to ", text(n("n_chain_changed")), " changed member(s) or class(es)"),
    ))
    late = clear & graded.isin("C", "D")
    effective = effective_grade(graded, ~clear, transitive, signoff)
    note = (
        F.when(late & ~transitive & (n("incompatible") == 0), "Nothing that the application calls changed; with approval the smaller test set would do.")
        .when(late & transitive & signoff, F.concat(F.lit("Counted as B with approval instead of "), graded, F.lit(": no changed member is reachable. The proof spans two libraries, so release slowly.")))
        .when(late & transitive, "No changed member is reachable; with approval this counts as B.")
    )
    out = facts.withColumns({"grade": graded, "effective_grade": effective, "reasons": reasons, "scope_note": note})
    shown = F.coalesce("effective_grade", "grade")
    return out.withColumns({"lane": lane(shown), "recipe": recipe(shown)})


def project_rollup(options: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (or one for each ``by``): the worst effective grade of the recommended options, the worst grade of the worst ones.

    ``options``: library, grade, effective_grade (null: as graded), in_place. Recommended is the least effective rank,
    in-place first; worst is the greatest. The two grades are on different scales on purpose: the worst ignores approvals.
    """
    by = by or []
    shown = rank(F.coalesce("effective_grade", "grade"))
    ranked = options.select(*by, "library", rank(F.col("grade")).alias("g"), shown.alias("e"), (~F.col("in_place")).alias("later"))
    per = ranked.groupBy(*by, "library").agg(F.min_by(F.struct("e", "g"), F.struct("e", "later", "g")).alias("best"), F.max_by(F.struct("e", "g"), F.struct("e", "later", "g")).alias("worst"))
    return per.groupBy(*by).agg(unrank(F.max("best.e")).alias("project_grade"), unrank(F.max("worst.g")).alias("without_best_path"), F.count("*").alias("n_libraries"))


def lane_histogram(libraries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """lane, n_direct and n_transitive of the recommended options (``lane``, ``transitive``)."""
    return libraries.groupBy(*(by or []), "lane").agg(F.count_if(~F.col("transitive")).alias("n_direct"), F.count_if("transitive").alias("n_transitive"))


def shrink_allowed(libraries: DataFrame, by: list[str]) -> DataFrame:
    """Whether every recommended option's shown grade permits a smaller set of tests; false where nothing is known."""
    shown = F.coalesce("effective_grade", "grade")
    return libraries.groupBy(*by).agg(F.coalesce(F.bool_and(shown.isin(*SHRINKABLE)), F.lit(False)).alias("shrink_allowed"))


def transitive_gate(libraries: DataFrame, fail_on: str | None) -> DataFrame:
    """One row: the worst shown grade of the transitive libraries (null without any) and whether it breaches ``fail_on``."""
    worst = libraries.where("transitive").agg(unrank(F.max(rank(F.coalesce("effective_grade", "grade")))).alias("worst"))
    return worst.withColumn("breached", breaches(F.col("worst"), fail_on))


def action_bucket(grade: Column) -> Column:
    """What a grade asks for: fix (F), test (B to D) or adopt (A)."""
    return F.when(grade == "F", "fix").when(grade.isin("B", "C", "D"), "test").when(grade == "A", "adopt")


def bucket_shares(libraries: DataFrame) -> DataFrame:
    """bucket ({F,D}, {C}, {B}, {A}), n and share_pct of the shown grades; a bar is at least 8 % wide."""
    shown = F.coalesce("effective_grade", "grade")
    bucket = F.when(shown.isin("F", "D"), "F,D").otherwise(shown)
    counted = libraries.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))  # five rows at most, so one window serves
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).cast("int")
    return counted.select("bucket", "n", F.greatest(share, F.lit(8)).alias("share_pct"))


def worst_first(libraries: DataFrame) -> DataFrame:
    """The libraries in order of display: worst shown grade first, then by name."""
    return libraries.orderBy(F.desc(rank(F.coalesce("effective_grade", "grade"))), "library")
