"""Judging applications against published evidence: options, libraries, project grade, hazards, and the routing payload."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.versions import is_remediated
from . import catalog, hazards, use
from .delta import MEMBER, machine_counts, unpack
from .grading import lane_histogram, project_rollup, rank, rate, shrink_allowed


@dataclass
class Scan:
    """The tables of a scan; every one has an app column."""

    options: DataFrame  # one row an application, library and version pair in use
    libraries: DataFrame  # one row an application and library, with the recommended and the worst option
    projects: DataFrame  # one row an application
    lanes: DataFrame
    heuristics: DataFrame
    hazards: DataFrame
    shipped: DataFrame
    unrated: DataFrame


def options(
    apps: DataFrame,
    published: DataFrame,
    components: DataFrame | None = None,
    parents: DataFrame | None = None,
    archives: DataFrame | None = None,
    pairs: DataFrame | None = None,
    parent_archives: DataFrame | None = None,
    signoff: bool = False,
) -> DataFrame:
    """Every version pair of a library that an application uses, rated.

    ``apps``: archive entries with an app column, bundled classes already left out. ``published``: pair, library, versions,
    stream and machine. Optional: ``components`` (app, grp, artifact, version) of the declared trees; ``archives`` (entries) with
    ``pairs`` (pair, old_path) to follow calls inside libraries; ``parents`` (library, parent) with ``parent_archives``
    (library, path) to look through a parent at libraries that the application does not use itself.
    """
    held, changes, classes = unpack(published)
    refs = use.references(apps)
    direct = use.intersect(refs, held, changes, classes).withColumns({"transitive": F.lit(False), "parent": F.lit(None).cast("string")})
    if archives is not None and pairs is not None:
        app_calls = use.calls(apps, "app").select("app", "owner", *MEMBER).distinct()
        chain = use.internal_chain(app_calls, archives, pairs, changes, classes)
        direct = direct.join(chain, ["app", "pair"], "left")
        direct = direct.withColumns({"n_chain_incompatible": F.size("internal_touched_incompatible"), "n_chain_changed": F.size("internal_touched_changed") + F.size("internal_touched_impl_changed")})
    used = direct
    if parents is not None and parent_archives is not None and archives is not None:
        through = published.select("pair", "library").join(parents, "library").join(parent_archives.select(F.col("library").alias("parent"), "path"), "parent").select("pair", "path", "parent")
        far = use.two_hop(apps, archives, through, held, changes, classes).join(direct.select("app", "pair"), ["app", "pair"], "left_anti")
        far = far.join(through.select("pair", "parent").distinct(), "pair").withColumn("transitive", F.lit(True))
        used = direct.unionByName(far, allowMissingColumns=True)
    facts = used.join(published, "pair").withColumns({"used": F.lit(True), "signoff": F.lit(signoff), "n_touched_incompatible": F.size("touched_incompatible"), "n_touched_changed": F.size("touched_changed")})
    rated = rate(facts.select("*", *machine_counts())).drop("used", "signoff", "machine")
    if components is not None:
        known = components.groupBy("app", F.col("artifact").alias("library")).agg(F.max(F.struct("version", "grp")).alias("c")).select("app", "library", F.col("c.version").alias("installed"), F.when(F.length("c.grp") > 0, F.concat_ws(":", "c.grp", "library")).alias("gav"))
        rated = rated.join(known, ["app", "library"], "left")
    else:
        rated = rated.withColumns({"installed": F.lit(None).cast("string"), "gav": F.lit(None).cast("string")})
    in_place = F.coalesce(F.col("installed") == F.col("old_version"), F.lit(True))
    confidence = F.struct(F.when(F.col("transitive"), "two-hop").otherwise("direct").alias("evidence"), F.col("effective_grade").isNotNull().alias("signed_off"))
    return rated.withColumns({"in_place": in_place, "remediated": is_remediated(F.col("new_version")), "confidence": confidence})


def libraries(rated: DataFrame) -> DataFrame:
    """One row an application and library: its options from best to worst, the recommended and the worst one.

    Options are ordered by shown grade, in-place ones first; of equal ones the lower pair comes first. Libraries come in
    the order of their parent or own name, transitive ones after; whether one is transitive its last pair says.
    """
    fields = [c for c in rated.columns if c not in ("app", "library", "gav", "installed")]
    order = F.struct(rank(F.coalesce("effective_grade", "grade")).alias("r"), (~F.col("in_place")).alias("later"), F.col("pair").alias("p"))
    gathered = rated.groupBy("app", "library").agg(F.collect_list(F.struct(order.alias("o"), F.struct(*fields).alias("v"))).alias("xs"), F.max("gav").alias("gav"), F.max("installed").alias("installed"), F.max_by("transitive", "pair").alias("transitive"), F.max_by("parent", "pair").alias("parent"))
    # an option may hold a map, which has no order, so options are compared by their order alone
    listed = gathered.withColumn("xs", F.array_sort("xs", lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)))
    out = listed.withColumn("options", F.transform("xs", lambda x: x["v"])).drop("xs")
    out = out.withColumns({"recommended": F.get("options", F.lit(0)), "worst": F.element_at("options", -1)})
    shown = out.withColumns({"grade": F.col("recommended.grade"), "effective_grade": F.col("recommended.effective_grade"), "lane": F.col("recommended.lane"), "call_sites": F.col("recommended.lib_call_sites")})
    return shown.orderBy("app", F.coalesce("parent", "library"), "transitive", "library")


def scan(apps: DataFrame, published: DataFrame, components: DataFrame | None = None, advisories: DataFrame | None = None, **more) -> Scan:
    """Every table of a scan of ``apps`` (archive entries with an app column) against published evidence."""
    held, changes, classes = unpack(published)
    view = use.without_bundled(apps, held)
    rated = options(view, published, components, **more)
    targets = rated.select(F.split_part(F.coalesce("gav", F.lit("")), F.lit(":"), F.lit(1)).alias("grp"), F.col("library").alias("artifact"), F.col("new_version").alias("version")).distinct()
    none = F.array().cast("array<string>")
    if advisories is not None:
        fixes = catalog.fixed_by(targets, advisories).groupBy(F.col("artifact").alias("library"), F.col("version").alias("new_version")).agg(F.array_sort(F.collect_set("cve")).alias("cves_fixed"))
        rated = rated.join(fixes, ["library", "new_version"], "left").withColumn("cves_fixed", F.coalesce("cves_fixed", none))
    else:
        rated = rated.withColumn("cves_fixed", none)
    libs = libraries(rated)
    chosen = libs.select("app", "library", F.col("recommended.pair").alias("pair"))
    hits = hazards.judge_hits(hazards.name_hits(view, held), changes, classes).join(chosen, ["app", "pair"])
    moved = hazards.relocated(apps, held.join(chosen.select("pair").distinct(), "pair", "left_semi")).join(chosen.select("app", "pair"), ["app", "pair"], "left_semi")
    if components is not None:
        shipped = hazards.inventory(apps, components)
        drifted = hazards.drift(shipped, components)
    else:
        shipped = hazards.embedded_coordinates(apps)
        drifted = hazards.drift(shipped, shipped).limit(0)
    rated_packages = rated.select("pair").distinct().join(held, "pair").select("package").distinct()
    projects = project_rollup(rated, ["app"]).join(shrink_allowed(libs, ["app"]), "app")
    return Scan(
        rated, libs, projects, lane_histogram(libs, ["app"]), hits, hazards.hazard_rows(drifted, moved, published.select("pair", "library")), shipped,
        use.third_party_packages(use.references(apps), apps, rated_packages),
    )


#: The obligations that every routing payload carries: one to meet in the build, two for later stages.
OBLIGATIONS = (
    {"id": "boot-test", "stage": "in-scope", "declaration": {"type": "tag", "value": "upgrade-gate"}, "min_resolved": 1},
    {"id": "canary", "stage": "downstream", "note": "belongs to the release; a build can neither run nor check it"},
    {"id": "rollback-path", "stage": "downstream", "note": "try the way back before the release goes on"},
)


def routing_upgrades(libs: DataFrame) -> DataFrame:
    """app and upgrades: the recommended option of each library as a routing payload lists it."""
    r = "recommended"
    up = F.struct(
        "library", F.concat_ws(" -> ", f"{r}.old_version", f"{r}.new_version").alias("path"), "lane", "grade", "effective_grade", "transitive", "parent",
        F.col(f"{r}.affected_app_classes"), F.col(f"{r}.affected_app_classes_changed"), F.col(f"{r}.confidence"),
    )
    place = F.struct(F.coalesce("parent", "library").alias("a"), F.col("transitive").alias("b"), F.col("library").alias("c"))
    return libs.groupBy("app").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("o"), up.alias("u")))), lambda x: x["u"]).alias("upgrades"))
