"""Deltas, use, hazards, scans and routing on small hand-made archives."""

import json

import pytest
from pyspark.sql import functions as F

from driftlens.operators import catalog, delta, diff, graph, grading, hazards, router, scan, use
from driftlens.sources import documents, projects
from driftlens.sources.archives import ENTRY

OBJECT = "java/lang/Object"


def cls(path, name, methods=(), parent=OBJECT, interfaces=(), access=0x21, sha=None, uses=(), strings=(), entry=None):
    """An archive entry of a class; a method is (name, desc, access, calls)."""
    key = lambda k: {"cls": k[0], "name": k[1], "desc": k[2]}
    members = [{"kind": "method", "name": n, "desc": d, "access": a, "calls": [key(c) for c in calls], "uses": list(uses)} for n, d, a, calls in methods]
    refs = sorted({c for m in methods for c in m[3]})
    return {"path": path, "entry": entry or f"{name}.class", "kind": "class", "sha256": sha or "s", "text": None, "cls": name, "access": access, "parent": parent, "interfaces": list(interfaces), "members": members, "refs": [key(r) for r in refs], "class_refs": sorted({*uses, *(r[0] for r in refs)}), "strings": list(strings), "fingerprint": (sha or "s").split(":")[0]}


def res(path, entry, text="x"):
    return {"path": path, "entry": entry, "kind": "resource", "sha256": text, "text": text}


def table(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def facts(spark, **f):
    base = {"stream": "z", "incompatible": 0, "modified": 0, "added": 0, "churn": 0.0, "resources": 0, "spi": 0}
    kinds = {"stream": "string", "churn": "double", "used": "boolean", "transitive": "boolean", "signoff": "boolean"}
    row = base | f
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'long')}" for k in row))


USED = {"used": True, "n_touched_incompatible": 0, "n_touched_changed": 0, "n_chain_incompatible": 0, "n_chain_changed": 0, "transitive": False, "signoff": False}
RULES = [
    ({"incompatible": 1}, "D", None), ({"modified": 1}, "D", None), ({"added": 1}, "B", None), ({"churn": 10.0}, "B", None), ({"churn": 9.9}, "A", None), ({"resources": 1}, "B", None), ({"spi": 1}, "B", None), ({}, "A", None),
    ({"stream": "y", "incompatible": 1}, "D", None), ({"stream": "y"}, "C", None), ({"stream": "x"}, "D", None), ({"stream": "unknown"}, "D", None),
    (USED | {"n_touched_incompatible": 1}, "F", None),
    (USED | {"stream": "y", "n_touched_changed": 1, "n_chain_incompatible": 1}, "C", None),  # a direct hit hides the chain
    (USED | {"n_chain_incompatible": 1}, "F", None), (USED | {"n_chain_changed": 1}, "B", None), (USED | {"stream": "y", "n_chain_changed": 1}, "C", None),
    (USED | {"stream": "y", "signoff": True}, "C", None),  # approval never changes a direct grade
    (USED | {"stream": "y", "transitive": True, "signoff": True}, "C", "B"), (USED | {"stream": "x", "transitive": True, "signoff": True, "n_chain_incompatible": 1}, "D", "B"), (USED | {"stream": "x", "transitive": True}, "D", None),
    ({"added": 0, "churn": round(100 / 976, 1), "resources": 2}, "B", None), ({"stream": "y", "churn": round(3000 / 182, 1), "added": 51}, "C", None),
]


def test_rating_rules(spark):
    rows = None
    for i, (given, _, _) in enumerate(RULES):
        one = grading.rate(facts(spark, **given)).select(F.lit(i).alias("i"), "grade", "effective_grade", "lane", "reasons", "scope_note", "recipe")
        rows = one if rows is None else rows.unionByName(one)
    got = {r.i: r for r in rows.collect()}
    for i, (given, grade, effective) in enumerate(RULES):
        assert (got[i].grade, got[i].effective_grade) == (grade, effective), given
        assert got[i].lane == grading.LANES[effective or grade][0] and got[i].reasons and got[i].recipe
    notes = {i: r.scope_note for i, r in got.items()}
    assert notes[17] and notes[18] and notes[20] and notes[12] is None and notes[0] is None


LIB = [
    cls("old", "lib/A", [("go", "()V", 1, [("lib/B", "deep", "()V")]), ("gone", "()V", 1, []), ("kept", "()V", 1, [])]),
    cls("old", "lib/B", [("deep", "()V", 0, [("lib/A", "go", "()V"), ("lib/C", "hidden", "()V")])]),
    cls("old", "lib/C", [("hidden", "()V", 1, [])], sha="c1"),
    cls("old", "lib/N", sha="n:1"), cls("old", "lib/Old"), cls("old", "lib/Itf", [("run", "()V", 0x401, [])], access=0x601),
    res("old", "META-INF/services/x", "1"), res("old", "META-INF/MANIFEST.MF", "1"), res("old", "same"),
    cls("new", "lib/A", [("go", "()V", 1, [("lib/B", "deep", "()V")]), ("kept", "()V", 0x11, []), ("more", "()V", 4, []), ("synthetic", "()V", 0x1001, [])], sha="a2"),
    cls("new", "lib/B", [("deep", "()V", 0, [])]), cls("new", "lib/C", [("hidden", "()V", 1, [])], sha="c2"), cls("new", "lib/N", sha="n:2"), cls("new", "lib/Itf", [("run", "()V", 0x401, [])], access=0x601),
    res("new", "META-INF/services/x", "2"), res("new", "META-INF/MANIFEST.MF", "2"), res("new", "same"), res("new", "added"),
]
PAIRS = "pair string, library string, old_version string, new_version string, old_path string, new_path string"


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([("p", "lib", "1.0.0", "1.0.1", "old", "new")], PAIRS)


@pytest.fixture(scope="module")
def published(spark, pairs):
    made = delta.evidence(pairs, table(spark, LIB))
    return spark.createDataFrame(made.collect(), made.schema)


def test_evidence_of_a_pair(published):
    r = published.first()
    m = r.machine
    assert m.packages == ["lib"] and m.classes_common == 5 and m.classes_impl_changed == ["lib/A", "lib/C"] and m.classes_build_noise == ["lib/N"] and m.impl_churn_pct == 40.0
    assert m.api_removed == [["lib/A", "gone", "()V"], ["lib/Old", None, None]] and m.api_added == [["lib/A", "more", "()V"]]
    assert m.api_modified == [["lib/A", "kept", "()V"]] and m.api_incompatible == [["lib/A", "gone", "()V"], ["lib/A", "kept", "()V"], ["lib/Old", None, None]]
    assert (m.res_changed, m.res_added, m.res_removed, m.spi_touched) == (["META-INF/MANIFEST.MF", "META-INF/services/x"], ["added"], [], ["META-INF/services/x"])
    assert (r.stream, r.grade, r.resources) == ("z", "D", 2)


def test_evidence_of_equal_and_empty_archives(spark, pairs):
    same = [r | {"path": p} for r in LIB if r["path"] == "old" for p in ("old", "new")]
    r = delta.evidence(pairs, table(spark, same)).first()
    assert r.grade == "A" and r.machine.impl_churn_pct == 0.0 and not r.machine.api_removed
    r = delta.evidence(pairs, table(spark, [])).first()
    assert r.grade == "A" and r.machine.classes_common == 0 and r.machine.packages == []


APP = [
    cls("app", "my/Main", [("main", "()V", 9, [("lib/A", "go", "()V"), ("lib/A", "gone", "()V"), ("other/X", "y", "()V"), ("java/util/List", "size", "()I")])], uses=["lib/Old"], strings=["lib.A.nested", "no"]),
    cls("app", "my/Quiet", [("q", "()V", 1, [("lib/A", "go", "()V")])]), cls("app", "lib/Bundled", [("b", "()V", 1, [("lib/A", "kept", "()V")])]),
    cls("calm", "we/Only", [("o", "()V", 1, [("lib/A", "go", "()V")])]), cls("none", "no/Use", [("o", "()V", 1, [])]),
    res("app", "META-INF/maven/g/bundled/pom.properties", "#c\nartifactId=bundled\nversion=2\n"), res("app", "conf.xml", "<a class='lib.C.Inner'/> lib.Zed.thing other.pkg.name"),
    cls("app", "lib/Moved", entry="shade/lib/Moved.class"),
]


@pytest.fixture(scope="module")
def apps(spark):
    return table(spark, APP).withColumn("app", F.col("path"))


def test_one_hop_use(spark, apps, published):
    held, changes, classes = delta.unpack(published)
    view = use.without_bundled(apps, held)
    assert {r.cls for r in view.where("kind = 'class'").collect()} == {"my/Main", "my/Quiet", "we/Only", "no/Use"}
    assert [r.entry for r in view.where("kind = 'resource'").collect()] == ["conf.xml"]
    got = {r.app: r for r in use.intersect(use.references(view), held, changes, classes).collect()}
    assert set(got) == {"app", "calm"}
    a = got["app"]
    assert a.lib_call_sites == 2 and a.lib_classes_used == ["lib.A", "lib.Old"] and [k.name for k in a.touched_changed] == ["gone"]
    assert [(k.cls, k.name) for k in a.touched_incompatible] == [("lib/A", "gone"), ("lib/Old", None)] and a.touched_impl_changed == ["lib.A"]
    assert a.affected_app_classes == ["my.Main", "my.Quiet"] and a.affected_app_classes_changed == ["my.Main"]
    assert got["calm"].touched_changed == [] and got["calm"].affected_app_classes_changed == []
    third = use.third_party_packages(use.references(apps), apps, held)
    assert [(r.app, r.package) for r in third.collect()] == [("app", "other")]


def test_chain_inside_the_library_on_a_cyclic_graph(spark, apps, published, pairs):
    held, changes, classes = delta.unpack(published)
    calls = use.calls(apps.where("cls LIKE 'we/%' OR cls LIKE 'no/%'"), "app")
    got = use.internal_chain(calls, table(spark, LIB).where("path = 'old'"), pairs, changes, classes).collect()
    assert len(got) == 1 and got[0].app == "calm" and got[0].closure_methods_reached == 3
    assert got[0].internal_touched_impl_changed == ["lib.A", "lib.C"] and got[0].internal_touched_changed == [] and got[0].internal_seed_owners == ["we.Only"]


def test_two_hops_through_a_parent(spark, published):
    parent = [
        cls("parent", "par/Front", [("call", "()V", 1, [("par/Base", "work", "()V")]), ("idle", "()V", 1, [("lib/A", "kept", "()V")])]),
        cls("parent", "par/Base", [("work", "()V", 1, [])]),
        cls("parent", "par/Sub", [("work", "()V", 1, [("lib/A", "gone", "()V")])], parent="par/Base"),
    ]
    app = [cls("app", "my/Main", [("main", "()V", 9, [("par/Front", "call", "()V")])]), cls("far", "no/Use", [("o", "()V", 1, [])])]
    held, changes, classes = delta.unpack(published)
    parents = spark.createDataFrame([("p", "parent", "par")], "pair string, path string, parent string")
    got = use.two_hop(table(spark, app).withColumn("app", F.col("path")), table(spark, parent), parents, held, changes, classes).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.app, r.reachable_parent_methods, r.reachable_parent_classes, r.lib_call_sites) == ("app", 3, 2, 1)
    assert [k.name for k in r.touched_incompatible] == ["gone"] and r.via == {"lib.A#gone ()V": "par.Sub"} and r.affected_app_classes == ["my.Main"]
    assert r.class_level_would_touch == ["lib.A#kept ()V"]


def test_dispatch_and_closure_end_on_cycles(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    supers = frame([("A", "B"), ("B", "A"), ("C", "B")], "child string, parent string")
    got = graph.dispatch(frame([("A", "run")], "cls string, name string"), frame([("B", "run"), ("C", "run")], "cls string, name string"), supers, frame([], "cls string, interface string"))
    assert {r.target for r in got.collect()} == {"B", "C"}
    ring = frame([(i, (i + 1) % 40) for i in range(40)], "src int, dst int")
    assert graph.closure(frame([(3,)], "node int"), ring).count() == 40
    scoped = frame([("x", 1, 2), ("y", 2, 3)], "s string, src int, dst int")
    assert {tuple(r) for r in graph.closure(frame([("x", "t", 1)], "s string, tag string, node int"), scoped, ["s"]).collect()} == {("x", "t", 1), ("x", "t", 2)}


def test_three_way_keeps_null_values_apart_from_missing_keys(spark):
    side = lambda rows: spark.createDataFrame(rows, "k int, v int")
    got = {r.k: r.status for r in diff.three_way(side([(1, None), (2, 5), (3, 1), (4, None), (None, 1)]), side([(1, 3), (2, None), (4, None), (5, 1), (None, 1)]), "k", "v").collect()}
    assert got == {1: "changed", 2: "changed", 3: "removed", 4: "same", 5: "added", None: "same"}


def test_hazards(spark, apps, published):
    held, changes, classes = delta.unpack(published)
    view = use.without_bundled(apps, held)
    hits = hazards.judge_hits(hazards.name_hits(view, held), changes, classes)
    assert {(r.fqcn, r.intersects_change, tuple(r.found_in)) for r in hits.collect()} == {("lib.A.nested", True, ("string-constant in my.Main",)), ("lib.C.Inner", True, ("resource:conf.xml",)), ("lib.Zed.thing", False, ("resource:conf.xml",))}
    declared = spark.createDataFrame([("app", "g", "bundled", "1"), ("app", "my", "thing", "3"), ("app", "x.y", "lib-kit", "4"), ("app", "z", "lib", "5"), ("none", "g", "q", "1")], "app string, grp string, artifact string, version string")
    shipped = hazards.inventory(apps, declared)
    assert {(r.artifact, r.version) for r in shipped.where("app = 'app'").collect()} == {("bundled", "2"), ("thing", "3"), ("lib", "5")}
    assert {(r.artifact, r.kind) for r in hazards.drift(shipped, declared).collect()} == {("bundled", "version-drift"), ("lib-kit", "declared-not-shipped")}
    moved = hazards.relocated(apps, held)
    assert [tuple(r) for r in moved.collect()] == [("app", "p", "lib", "shade/")]
    rows = hazards.hazard_rows(hazards.drift(shipped, declared), moved, published.select("pair", "library"))
    assert sorted(r.kind for r in rows.collect()) == ["declared-not-shipped", "relocated-copy", "version-drift"]


def test_scan_from_evidence_to_payload(spark, apps, published, pairs):
    second = published.withColumns({"pair": F.lit("q"), "new_version": F.lit("1.1.0.rhlw-1"), "stream": F.lit("y")})
    both = published.select("pair", "library", "old_version", "new_version", "stream", "machine").unionByName(second.select("pair", "library", "old_version", "new_version", "stream", "machine"))
    components = spark.createDataFrame([("app", "g", "lib", "1.0.0")], "app string, grp string, artifact string, version string")
    advice = spark.createDataFrame([("CVE-1", "g:lib", "1.0.5", "s"), ("CVE-2", "lib", "9", "s")], "cve string, package string, fixed string, summary string")
    archives = table(spark, LIB).where("path = 'old'")
    s = scan.scan(apps, both, components, advice, archives=archives, pairs=spark.createDataFrame([("p", "old"), ("q", "old")], "pair string, old_path string"))
    libs = {r.app: r for r in s.libraries.collect()}
    assert set(libs) == {"app", "calm"} and libs["app"].grade == "F" and libs["app"].gav == "g:lib" and libs["app"].installed == "1.0.0" and len(libs["app"].options) == 2
    by = {o.new_version: o for o in libs["app"].options}
    assert by["1.1.0.rhlw-1"].cves_fixed == ["CVE-1"] and by["1.0.1"].cves_fixed == [] and by["1.1.0.rhlw-1"].remediated and by["1.0.1"].in_place
    assert libs["calm"].recommended.grade == "D" and libs["calm"].recommended.internal_touched_impl_changed == ["lib.A", "lib.C"]
    projects_ = {r.app: r for r in s.projects.collect()}
    assert projects_["app"].project_grade == "F" and not projects_["app"].shrink_allowed and projects_["calm"].without_best_path == "D"
    assert {(r.app, r.n_direct) for r in s.lanes.collect()} == {("app", 1), ("calm", 1)}
    up = {r.app: r.upgrades for r in scan.routing_upgrades(s.libraries).collect()}
    assert up["app"][0].path == "1.0.0 -> 1.0.1" and up["app"][0].confidence.evidence == "direct" and up["app"][0].affected_app_classes == ["my.Main", "my.Quiet"]
    assert [r.package for r in s.unrated.collect()] == ["other"]


def test_router_selects_widens_and_skips(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    suite = f([(t,) for t in "ABCDE"], "test string")
    covers = f([("A", "x.Y"), ("A", "x.Z"), ("B", "x.W"), ("C", "x.Q"), ("D", None)], "test string, cls string")
    affected = f([("x.Y", "zlib 1 -> 2 [direct]", 0), ("x.Y", "alib 1 -> 2 [direct]", 1), ("x.Z", "alib 1 -> 2 [direct]", 1)], "cls string, reason string, at int")
    got = {r.test: (r.bucket, r.why) for r in router.route(suite, covers, affected, f([("x.W",)], "cls string"), []).collect()}
    assert got["A"] == ("selected", "covers x.Y <- zlib 1 -> 2 [direct] & alib 1 -> 2 [direct]; covers x.Z <- alib 1 -> 2 [direct]")
    assert {t: b for t, (b, _) in got.items()} == {"A": "selected", "B": "widened", "C": "skipped", "D": "skipped", "E": "selected"}
    assert {r.bucket for r in router.route(suite, covers, affected, f([], "cls string"), ["old map"]).collect()} == {"selected"}
    libs = f([("zlib",), ("alib",), ("lib",)], "library string")
    entries = f([("A", got["A"][1]), ("E", got["E"][1])], "test string, reason string")
    assert {tuple(r) for r in router.tests_by_library(entries, libs).collect()} == {("zlib", "A"), ("alib", "A")}
    plain = f([("A", "whole suite: x"), ("B", "whole suite: x")], "test string, reason string")
    by = router.tests_by_library(plain, libs, covers, f([("lib", "x.Z"), ("zlib", "x.W"), ("gone", "x.Y")], "library string, cls string"))
    assert {tuple(r) for r in by.collect()} == {("lib", "A"), ("zlib", "B")}
    results = {r.library: (r.status, r.failed_names) for r in router.results_by_library(by, libs, f([("p.A.m",)], "name string"), True, 1).collect()}
    assert results == {"lib": ("failed", ["p.A.m"]), "zlib": ("passed", []), "alib": ("not_selected", [])}
    assert {r.status for r in router.results_by_library(by, libs, f([], "name string"), True, 2).collect()} == {"failed", "not_selected"}
    assert {r.status for r in router.results_by_library(by, libs, f([], "name string"), False, 0).collect()} == {"not_run"}


def test_failures_meet_tests_by_whole_tokens(spark):
    f = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = router.attribute(f(["com.acme.OrderTest.places", "OrderTestIT.total", "com.acme.OrderTest#x", "lower.case.only", "pkg.suite.m", None], "name"), f(["OrderTest", "case", "pkg.suite", "com.acme.OrderTest"], "test"))
    assert {tuple(r) for r in got.collect()} == {("com.acme.OrderTest.places", "OrderTest"), ("com.acme.OrderTest.places", "com.acme.OrderTest"), ("com.acme.OrderTest#x", "OrderTest"), ("com.acme.OrderTest#x", "com.acme.OrderTest"), ("lower.case.only", "case"), ("pkg.suite.m", "pkg.suite")}


POM = """<project xmlns="http://maven.apache.org/POM/4.0.0"><!-- <dependencies><dependency><groupId>c</groupId><artifactId>c</artifactId><version>1</version></dependency></dependencies> -->
<properties><a.v> {0} </a.v><empty/></properties>
<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${{a.v}}</version><exclusions><exclusion><groupId>e</groupId><artifactId>e</artifactId></exclusion></exclusions></dependency>
<dependency><groupId>g</groupId><artifactId>b</artifactId><version>${{parent.v}}</version></dependency><dependency><groupId>g</groupId><artifactId>nov</artifactId></dependency>{1}</dependencies>
<dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>m</artifactId><version>3</version></dependency></dependencies></dependencyManagement>
<build><plugins><plugin><dependencies><dependency><groupId>pl</groupId><artifactId>pl</artifactId><version>1</version></dependency></dependencies></plugin></plugins></build></project>"""


def test_poms_and_trees(spark, tmp_path):
    extra = "<dependency><groupId>n</groupId><artifactId>n</artifactId><version>1</version></dependency>"
    (tmp_path / "base.xml").write_text(POM.format("1.0", ""))
    (tmp_path / "head.xml").write_text(POM.format("1.0.rhlw-00001", extra).replace("<groupId>m</groupId>", "<groupId>mm</groupId>"))
    read = lambda n: projects.pom_dependencies(projects.poms(spark, str(tmp_path / n)))
    base, head = read("base.xml"), read("head.xml")
    assert sorted((r.grp, r.artifact, r.version) for r in base.collect()) == [("g", "a", "1.0"), ("g", "b", "${parent.v}"), ("m", "m", "3")]
    got = projects.pom_changes(base, head)
    assert sorted((r.grp, r.change, r.adopted) for r in got.collect()) == [("g", "changed", True), ("m", "removed", False), ("mm", "added", False), ("n", "added", False)]
    assert projects.primary_change(got).first().artifact == "a"
    direct = projects.pom_dependencies(projects.poms(spark, str(tmp_path / "head.xml")), managed=False)
    assert sorted((r.grp, r.version) for r in projects.pom_components(direct).collect()) == [("g", "1.0.rhlw-00001"), ("n", "1")]
    (tmp_path / "t1.txt").write_text("[x\ng:a:jar:1:compile\n+- g:b:ejb:2:import\n|  \\- g:c:jar:linux:3:test\n\\- g:b:jar:2.5:runtime\nnot: a line\n")
    (tmp_path / "t2.txt").write_text("+- g:b:jar:4:compile\n+- g:c:jar:9:test\n+- g:d:jar:1:test\n")
    t1, t2 = (documents.dependency_tree(spark, str(tmp_path / n)) for n in ("t1.txt", "t2.txt"))
    assert {(r.artifact, r.version) for r in t1.collect()} == {("a", "1"), ("b", "2.5"), ("c", "3")}
    assert {(r.artifact, r.old_version, r.new_version) for r in projects.tree_changes(t1, t2, spark.createDataFrame([("g", "c")], "grp string, artifact string")).collect()} == {("b", "2.5", "4")}


def test_test_sources_reports_and_logs(spark, tmp_path):
    src, rep = tmp_path / "src" / "deep", tmp_path / "rep"
    src.mkdir(parents=True), rep.mkdir()
    (src / "GateIT.java").write_text('@Tag( "slow" )\n@UpgradeGate class GateIT {}')
    (src / "PlainTest.java").write_text("@UpgradeGates class PlainTest {}")
    sources = projects.test_sources(spark, str(tmp_path / "src"))
    assert sorted(r.test for r in sources.collect()) == ["GateIT", "PlainTest"]
    assert sorted(tuple(r) for r in projects.tagged_tests(sources).select("tag", "test").collect()) == [("slow", "GateIT"), ("upgrade-gate", "GateIT")]
    (rep / "a.txt").write_text("Tests run: 5, Failures: 1, Errors: 1, Skipped: 0")
    (rep / "b.txt").write_text("Tests run: 2, Failures: 0, Errors: 0\nTests run: 9, Failures: 9, Errors: 9")
    (rep / "TEST-a.xml").write_text('<testsuite><testcase classname="p.A" name="ok"/><testcase name="bad" classname="p.A"><failure message="m">t</failure></testcase><testcase classname="p.q.B" name="worse" time="1"><error/></testcase><testcase classname="p.A" name="fine"></testcase></testsuite>')
    assert tuple(projects.report_totals(spark, str(rep)).first()) == (2, 7, 2, 5)
    assert sorted(r.name for r in projects.failed_names(spark, str(rep)).collect()) == ["A.bad", "B.worse"]
    (tmp_path / "log.txt").write_text("  PASS A#x\nFAIL B#y -> boom: 1\nPASSED nothing\n")
    assert sorted(tuple(r) for r in projects.runner_log(spark, str(tmp_path / "log.txt")).collect()) == [("FAIL", "B.y"), ("PASS", "A.x")]


def test_documents_of_other_tools(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    assert [tuple(r) for r in documents.change_list(spark, put("c1.json", {"changed": [{"group": "g", "artifact": "a", "old_version": "1", "new_version": "2"}], "added": [{"groupId": "h", "artifactId": "b", "toVersion": "3"}, {"group": "x"}]})).collect()] == [("g", "a", "1", "2"), ("h", "b", "", "3")]
    assert [tuple(r) for r in documents.change_list(spark, put("c2.json", [{"artifact": "z"}])).collect()] == [("", "z", "", "")]
    sbom = {"metadata": {"component": {"name": "root"}}, "components": [], "dependencies": [{"ref": "root@1", "dependsOn": ["a@1", "b@1"]}, {"ref": "a@1", "dependsOn": ["c@1"]}, {"ref": "b@1", "dependsOn": ["c@1"]}]}
    edges = documents.sbom_edges(spark, put("s.json", sbom))
    assert {(r.parent, r.child) for r in edges.where("is_root").collect()} == {("root", "a"), ("root", "b")}
    assert [tuple(r) for r in documents.parents(edges).collect()] == [("c", "b")]
    folder = tmp_path / "ev"
    folder.mkdir()
    (folder / "e.json").write_text(json.dumps({"library": "l", "old_version": "1", "new_version": "2", "stream": "z", "machine": {"packages": ["p"], "api_removed": [["p/A", None, None]], "api_added": [], "api_modified": [], "api_incompatible": [["p/A", None, None]], "classes_impl_changed": [], "classes_build_noise": []}}))
    (folder / "f.json").write_text(json.dumps({"library": "no machine"}))
    read = documents.evidence(spark, str(folder))
    held, changes, _ = delta.unpack(read)
    assert read.count() == 1 and held.first().package == "p" and tuple(changes.drop("pair").first()) == ("p/A", None, None, "removed", True)
    assert tuple(documents.coverage_totals(spark, put("t.json", {"totals": {"dependencies": 3, "exact": 1}})).first()) == (3, 1, 0, 0)


def test_catalog_totals_marks_and_freshness(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    parts = f([("g", "a", "1"), ("g", "b", "2"), (None, "c", "1"), ("g", "d", "0.9")], "grp string, artifact string, version string")
    held = f([("g", "a", "1", "1.rhlw-1"), ("g", "b", "3", "3.rhlw-1"), ("g", "b", "10", "10.rhlw-1"), ("g", "d", "0.8", "0.8.rhlw-1")], "grp string, artifact string, base_version string, full_version string")
    rows = catalog.bucket(parts, held)
    assert {r.artifact: (r.bucket, r.serviced) for r in rows.collect()} == {"a": ("exact", None), "b": ("near", ["3.rhlw-1", "10.rhlw-1"]), "c": ("uncovered", None), "d": ("uncovered", None)}
    assert tuple(catalog.totals(rows).first()) == (4, 1, 1, 2, 25) and tuple(catalog.totals(rows.limit(0)).first()) == (0, 0, 0, 0, 0)
    marked = catalog.mark_changes(rows, f([("g", "d"), (None, "zz")], "grp string, artifact string")).collect()
    assert [r.artifact for r in marked] == ["d", "c", "a", "b"] and marked[0].in_this_change
    fresh = catalog.freshness(held, f([("g", "a", "1.rhlw-1"), ("g", "b", "11")], "grp string, artifact string, latest string"))
    assert {(r.artifact, r.state) for r in fresh.collect()} == {("a", "SAME"), ("b", "DIFFERS"), ("d", "NOT_FOUND")}


def test_gates_and_buckets(spark):
    libs = spark.createDataFrame([("a", "D", None, False), ("b", "C", "B", True), ("c", "A", None, True), ("d", "F", None, False)], "library string, grade string, effective_grade string, transitive boolean")
    assert tuple(grading.transitive_gate(libs, "C").first()) == ("B", False) and tuple(grading.transitive_gate(libs, "B").first()) == ("B", True)
    assert not grading.transitive_gate(libs, "").first().breached and grading.transitive_gate(libs.limit(0), "A").first().breached is False
    assert [r.library for r in grading.worst_first(libs).collect()] == ["d", "a", "b", "c"]
    assert {r.bucket: (r.n, r.share_pct) for r in grading.bucket_shares(libs).collect()} == {"F,D": (2, 50), "B": (1, 25), "A": (1, 25)}
    assert [r[0] for r in libs.select(grading.action_bucket(F.col("grade"))).collect()] == ["test", "test", "adopt", "fix"]
