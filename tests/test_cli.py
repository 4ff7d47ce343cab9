"""The command line from archives to a test plan, on hand-made archives."""

import json

from test_sources import jar, make_class

from driftlens import cli


def test_archives_to_plan(spark, tmp_path, capsys):
    go, gone = ("go", "()V", 1, []), ("gone", "()V", 1, [])
    files = {
        "lib-1.0.0.jar": {"lib/A.class": make_class("lib/A", [go, gone]), "META-INF/services/x": b"1"},
        "lib-1.0.1.jar": {"lib/A.class": make_class("lib/A", [go])},
        "app.jar": {"my/Main.class": make_class("my/Main", [("main", "()V", 9, [("lib/A", "gone", "()V")])]), "c.properties": b"k=lib.A.Inner"},
    }
    at = {name: str(tmp_path / name) for name in files}
    for name, entries in files.items():
        (tmp_path / name).write_bytes(jar(entries))
    p = lambda name: str(tmp_path / name)
    read = lambda name: json.loads((tmp_path / name).read_text())
    assert cli.main(["analyze", at["lib-1.0.0.jar"], at["lib-1.0.1.jar"], "--old-version", "1.0.0", "--new-version", "1.0.1", "--library", "lib", "--json", p("evidence.json"), "--html", p("e.html")]) == 0
    e = read("evidence.json")
    assert e["rating"]["grade"] == "D" and e["machine"]["api_removed"] == [["lib/A", "gone", "()V"]] and e["delta"]["api_removed"] == ["lib.A#gone ()V"]
    assert cli.main(["analyze", at["lib-1.0.0.jar"], at["lib-1.0.1.jar"], "--old-version", "1", "--new-version", "2", "--app", at["app.jar"], "--transitive-of", "x"]) == 2
    (tmp_path / "sbom.json").write_text(json.dumps({"metadata": {"component": {"name": "app"}}, "components": [{"group": "g", "name": "lib", "version": "1.0.0"}], "dependencies": []}))
    assert cli.main(["scan", at["app.jar"], "--evidence", p("evidence.json"), "--sbom", p("sbom.json"), "--json", p("card.json"), "--html", p("c.html"), "--routing-payload", p("routing.json"), "--fail-on", "F"]) == 2
    card = read("card.json")
    assert card["project"]["headline_grade"] == "F" and card["libraries"][0]["recommended"]["touched_incompatible"] == ["lib.A#gone ()V"] and card["heuristics"][0]["intersects_change"]
    assert read("routing.json")["shrink_allowed"] is False
    tests = tmp_path / "tests"
    tests.mkdir()
    args = ["route", p("routing.json"), "--tests", str(tests), "--head", "h", "--out", p("plan")]
    assert cli.main(args) == 0 and read("plan/selection-report.json")["mode"] == "REACHABILITY_ONLY"
    (tests / "MainTest.java").write_text("class MainTest {}")
    assert cli.main(args) == 3
    (tests / "GateIT.java").write_text("@UpgradeGate class GateIT {}")
    assert cli.main(args) == 0 and (tmp_path / "plan/includes.txt").read_text() == "**/GateIT.java\n**/MainTest.java\n"
    assert cli.main(["record-test-results", "--out", p("results.json"), "--passed", "1", "--failed", "1", "--failed-name", "MainTest.x", "--selection", p("plan/selection-report.json"), "--scorecard", p("card.json")]) == 0
    assert read("results.json")["by_library"]["lib"]["status"] == "not_selected"
    (tmp_path / "catalog.json").write_text(json.dumps({"components": [{"group": "g", "name": "lib", "version": "1.0.0.rhlw-1"}]}))
    assert cli.main(["coverage", "--sbom", p("sbom.json"), "--catalog", p("catalog.json"), "--json", p("cov.json")]) == 0 and read("cov.json")["totals"]["exact"] == 1
    assert cli.main(["publish", p("evidence.json"), "--out", p("site")]) == 0 and (tmp_path / "site/index.html").exists()
    assert cli.main(["render-scorecard", p("card.json"), "--html", p("card.html")]) == 0
