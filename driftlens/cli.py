"""Command line: ``python -m driftlens.cli COMMAND``.

Exit codes: 0 done, 2 a grade reached --fail-on (or arguments do not fit), 3 a mandatory obligation is stale, 5 a seal does not hold.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from .operators import catalog, delta, grading, router, scan
from .session import build_session, ship_package
from .sinks import documents as out
from .sinks import reports, seals
from .sources import archives, documents, projects


def _load(spark, path):
    return out.read_json(spark, path) if path else None


def _app_entries(spark, paths):
    """The application's archives as one; of classes and resources that clash the later archive's count."""
    name = " + ".join(os.path.basename(p) for p in paths)
    parts = [archives.read_archives(spark, p, "*").withColumn("place", F.lit(i)) for i, p in enumerate(paths)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    key = F.when(F.col("kind") == "class", F.col("cls")).otherwise(F.col("entry"))
    rest = F.struct(*[c for c in every.columns if c != "place"])
    last = every.withColumn("key", key).groupBy("kind", "key").agg(F.max_by(rest, "place").alias("r")).select("r.*")
    return last.withColumn("app", F.lit(name)), name


def analyze(spark, a) -> int:
    """Old and new archive of a library to evidence; with --app also what the application touches."""
    entries = archives.read_archives(spark, a.old_archive, "*").unionByName(archives.read_archives(spark, a.new_archive, "*")).cache()
    paths = [archives.read_archives(spark, p, "*").select("path").first()[0] for p in (a.old_archive, a.new_archive)]
    library = a.library or os.path.basename(a.old_archive)
    pairs = spark.createDataFrame([(library, library, a.old_version, a.new_version, *paths)], "pair string, library string, old_version string, new_version string, old_path string, new_path string")
    made = delta.evidence(pairs, entries).cache()
    document = json.loads(reports.evidence_documents(made).first().document)
    if a.app:
        app, name = _app_entries(spark, [a.app])
        more = {}
        if a.transitive_of:
            if not a.parent_archive:
                print("--transitive-of needs --parent-archive", file=sys.stderr)
                return 2
            parent = archives.read_archives(spark, a.parent_archive, "*")
            where = parent.select("path").first()[0]
            more = {"parents": spark.createDataFrame([(library, a.transitive_of)], "library string, parent string"), "parent_archives": spark.createDataFrame([(a.transitive_of, where)], "library string, path string"), "archives": parent}
        else:
            more = {"archives": entries.where(F.col("path") == paths[0]), "pairs": pairs.select("pair", "old_path")}
        result = scan.scan(app, made.select("pair", "library", "old_version", "new_version", "stream", "machine"), signoff=a.accept_transitive_scope, **more)
        card = reports.scorecard(result, name)
        document |= {"app": name, "app_intersection": card["libraries"][0]["recommended"] if card["libraries"] else None}
        if card["libraries"]:
            document["rating"] = {k: card["libraries"][0]["recommended"].get(k) for k in document["rating"]}
        if a.routing_payload:
            out.write_json(spark, a.routing_payload, reports.routing_payload(result, name))
        if a.scorecard and card["libraries"]:
            out.write_json(spark, a.scorecard, reports.merge_scorecard(_load(spark, a.scorecard), card["libraries"][0]))
    if a.json:
        out.write_json(spark, a.json, document)
    if a.html:
        out.write_text(spark, a.html, reports.evidence_page(document))
    print(f"{document['library']} {document['old_version']} -> {document['new_version']}: {document['rating']['effective_grade'] or document['rating']['grade']}")
    return 0


def scan_(spark, a) -> int:
    """Application archives against published evidence."""
    app, name = _app_entries(spark, a.archives)
    published = documents.evidence(spark, a.evidence).cache()
    more, components, advisories = {"signoff": a.accept_transitive_scope}, None, None
    if a.sbom:
        components = documents.sbom_components(spark, a.sbom).withColumn("app", F.lit(name)).select("app", "grp", "artifact", "version")
        more["parents"] = documents.parents(documents.sbom_edges(spark, a.sbom)).select(F.col("child").alias("library"), "parent")
    if a.lib_archives:
        entries = archives.read_archives(spark, a.lib_archives)
        file = F.regexp_extract("path", r"([^/]+)\.jar$", 1)
        paths = entries.select("path").distinct().withColumn("file", file)
        more["archives"] = entries
        more["pairs"] = published.select("pair", F.concat_ws("-", "library", "old_version").alias("file")).join(paths, "file").select("pair", F.col("path").alias("old_path"))
        if components is not None:
            more["parent_archives"] = components.select(F.col("artifact").alias("library"), F.concat_ws("-", "artifact", "version").alias("file")).join(paths, "file").select("library", "path")
    if a.osv_dir:
        advisories = documents.advisories(spark, a.osv_dir)
        if a.osv_more:  # the local folder's documents win
            advisories = advisories.unionByName(documents.advisories(spark, a.osv_more).join(advisories.select("id").distinct(), "id", "left_anti"))
    result = scan.scan(app, published.select("pair", "library", "old_version", "new_version", "stream", "machine"), components, advisories, **more)
    coverage = documents.coverage_totals(spark, a.coverage).first() if a.coverage else None
    card = reports.scorecard(result, name, coverage.asDict() if coverage else None)
    print(reports.terminal(card), end="")
    if a.json:
        out.write_json(spark, a.json, card)
    if a.html:
        out.write_text(spark, a.html, reports.scorecard_page(card))
    if a.routing_payload:
        out.write_json(spark, a.routing_payload, reports.routing_payload(result, name))
    grade = card["project"]["headline_grade"]
    return 2 if a.fail_on and grade and grading.GRADES.index(grade) >= grading.GRADES.index(a.fail_on) else 0


def coverage(spark, a) -> int:
    """Declared components against the catalogue of remediated builds."""
    parts = documents.sbom_components(spark, a.sbom)
    found = catalog.bucket(parts, documents.catalog(spark, a.catalog)).cache()
    name = (_load(spark, a.sbom).get("metadata") or {}).get("component", {}).get("name") or os.path.basename(a.sbom)
    changes = documents.change_list(spark, a.this_change) if a.this_change else None
    marked = found if changes is None else catalog.mark_changes(found, changes)
    document = reports.coverage_document(marked, catalog.totals(found), name, None if changes is None else reports.rows(changes))
    print(f"{name}: " + ", ".join(f"{k} {v}" for k, v in document["totals"].items()))
    if a.json:
        out.write_json(spark, a.json, document)
    if a.html:
        out.write_text(spark, a.html, reports.coverage_page(document))
    return 0


def publish(spark, a) -> int:
    """A site of evidence pages."""
    for name, text in reports.site([_load(spark, p) for p in a.files]).items():
        out.write_text(spark, f"{a.out}/{name}", text)
    return 0


def render_scorecard(spark, a) -> int:
    out.write_text(spark, a.html, reports.scorecard_page(_load(spark, a.scorecard)))
    return 0


def record_test_results(spark, a) -> int:
    """The results document of a run, attributed to the scorecard's libraries."""
    selection, card = _load(spark, a.selection) or {}, _load(spark, a.scorecard) or {}
    names = [e["library"] for e in card.get("libraries") or [] if e.get("library")]
    libraries = spark.createDataFrame([(n,) for n in names], "library string")
    entries = [(e["test"], e.get("reason")) for part in ("selected", "widened") for e in selection.get(part) or []] + [(t, "mandatory") for t in (selection.get("mandatory") or {}).get("appended") or []]
    covers = documents.coverage_map(spark, a.coverage) if a.coverage else None
    routed = _load(spark, a.routing) if a.routing else None
    affected = None if routed is None else spark.createDataFrame([(u["library"], c) for u in routed.get("upgrades") or [] for c in u.get("affected_app_classes") or []], "library string, cls string")
    by = router.tests_by_library(spark.createDataFrame(entries, "test string, reason string"), libraries, covers, affected)
    failed = spark.createDataFrame([(n,) for n in a.failed_name], "name string")
    results = router.results_by_library(by, libraries, failed, a.status == "ran", a.failed)
    out.write_json(spark, a.out, reports.test_results(results, a.passed, a.failed, a.failed_name, a.summary, a.status, selection))
    return 0


def route(spark, a) -> int:
    """Which tests a routing payload asks for."""
    payload = _load(spark, a.routing)
    sources = projects.test_sources(spark, a.tests) if os.path.isdir(a.tests) and any(f.endswith(".java") for _, _, names in os.walk(a.tests) for f in names) else spark.createDataFrame([], "test string, text string")
    seen = documents.coverage_provenance(spark, a.coverage).first() if a.coverage and os.path.exists(a.coverage) else None
    covers = documents.coverage_map(spark, a.coverage).select("test", "cls") if seen else None
    try:
        made = reports.plan_tests(spark, payload, sources, covers, seen.asDict() if seen else None, projects.tagged_tests(sources), a.head, a.changed_since.split(","), a.most_age)
    except reports.StaleObligation as e:
        print(f"stale obligation: {e}", file=sys.stderr)
        return 3
    out.write_text(spark, f"{a.out}/includes.txt", "".join(f"{r.value}\n" for r in out.includes(made["final"]).collect()))
    out.write_json(spark, f"{a.out}/selection-report.json", made["report"])
    out.write_json(spark, f"{a.out}/deploy-gate.json", made["gate"])
    print(f"{made['report']['mode']}: {made['report']['totals']}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftlens")
    commands = top.add_subparsers(required=True, dest="command")

    def command(name, run, *args):
        sub = commands.add_parser(name, help=run and run.__doc__)
        for flags, more in args:
            sub.add_argument(*flags.split(), **more)
        sub.set_defaults(run=run)

    opt = {"default": None}
    flag = {"action": "store_true"}
    command("analyze", analyze, ("old_archive", {}), ("new_archive", {}), ("--old-version", {"required": True}), ("--new-version", {"required": True}), ("--library", opt), ("--app", opt), ("--transitive-of", opt), ("--parent-archive", opt), ("--accept-transitive-scope", flag), ("--json", opt), ("--html", opt), ("--routing-payload", opt), ("--scorecard", opt))
    command("scan", scan_, ("archives", {"nargs": "+"}), ("--evidence", {"nargs": "+", "required": True}), ("--sbom", opt), ("--lib-archives", opt), ("--osv-dir", opt), ("--osv-more", opt), ("--coverage", opt), ("--accept-transitive-scope", flag), ("--json", opt), ("--html", opt), ("--routing-payload", opt), ("--fail-on", {"choices": grading.GRADES}))
    command("coverage", coverage, ("--sbom", {"required": True}), ("--catalog", {"required": True}), ("--this-change", opt), ("--json", opt), ("--html", opt))
    command("publish", publish, ("files", {"nargs": "+"}), ("--out", {"required": True}))
    command("render-scorecard", render_scorecard, ("scorecard", {}), ("--html", {"required": True}))
    command("record-test-results", record_test_results, ("--out", {"required": True}), ("--passed", {"type": int, "default": 0}), ("--failed", {"type": int, "default": 0}), ("--failed-name", {"action": "append", "default": []}), ("--summary", {"default": ""}), ("--status", {"default": "ran"}), ("--selection", opt), ("--scorecard", opt), ("--routing", opt), ("--coverage", opt))
    command("route", route, ("routing", {}), ("--coverage", opt), ("--tests", {"required": True}), ("--head", {"required": True}), ("--changed-since", {"default": ""}), ("--most-age", {"type": int, "default": 25}), ("--out", {"required": True}))
    command("seal", None, ("files", {"nargs": "+"}), ("--key", {"required": True}))
    command("verify", None, ("files", {"nargs": "+"}), ("--pub", {"required": True}))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "seal":
        print(seals.seal(a.key, a.files))
        return 0
    if a.command == "verify":
        found = seals.verify(a.pub, a.files)
        print("\n".join(f"{state} {path}" for path, state in found.items()))
        return 0 if set(found.values()) <= {"verified"} else 5
    spark = build_session("driftlens")
    ship_package(spark)
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
