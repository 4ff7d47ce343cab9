"""Report documents: round trips, upserts and set splits."""

import hashlib
import json

import pytest

from driftlens.operators import router, scan
from driftlens.sinks import documents, reports


def test_text_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "deep" / "a.json")
    assert documents.read_text(spark, path) is None
    documents.write_json(spark, path, {"b": "é", "a": [1, None]})
    documents.write_json(spark, path, {"z": 1})
    assert json.loads((tmp_path / "deep" / "a.json").read_text()) == {"z": 1} == documents.read_json(spark, path)
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")] == ["a.json"]


def test_canonical_depends_on_values_only():
    assert documents.canonical(json.loads('{ "b": 1,\n "a": [ 2 ] }')) == b'{"a":[2],"b":1}' != documents.canonical({"a": [3], "b": 1})


def test_selection_and_includes(spark):
    frame = lambda *names: spark.createDataFrame([(n,) for n in names], "test string")
    rows = documents.split_selection(frame("A", "B", "C", None), frame("A", "A", "B"), frame("B", "M"))
    assert sorted(tuple(r) for r in rows.collect()) == [("A", True, False, True), ("B", True, True, True), ("C", False, False, False), ("M", False, True, True)]
    assert [r.value for r in documents.includes(rows.where("final")).collect()] == ["**/A.java", "**/B.java", "**/M.java"]
    assert documents.split_selection(frame(), frame(), frame()).count() == 0


def test_putting_twice_changes_nothing(spark):
    one = spark.createDataFrame([("a", "1", "2", "B")], "library string, old_version string, new_version string, grade string")
    two = spark.createDataFrame([("a", "1", "2", "F"), ("b", "1", "3", "A")], one.schema)
    once = documents.put_option(documents.put_option(None, one), two)
    assert sorted(tuple(r) for r in documents.put_option(once, two).collect()) == [("a", "1", "2", "F"), ("b", "1", "3", "A")]


def test_gate_and_signoff(spark, tmp_path):
    path, card = str(tmp_path / "gate.json"), tmp_path / "card.json"
    card.write_text('{"project": {"headline_grade": "C"}}')
    documents.close_obligation(spark, path, "canary", "OPEN", "wait")
    documents.close_obligation(spark, path, "audit", "OPEN")
    signed = documents.signoff(spark, str(card), "human", "x", "", "2026-01-01T00:00:00Z")
    gate = documents.close_obligation(spark, path, "canary", "CLOSED", None, signed)
    assert gate["obligations_downstream"] == [{"id": "canary", "status": "CLOSED", "note": "wait"}, {"id": "audit", "status": "OPEN", "note": ""}] and gate == documents.read_json(spark, path)
    assert signed["grade"] == "C" and signed["scorecard_sha256_16"] == hashlib.sha256(card.read_bytes()).hexdigest()[:16]


def payload(**more):
    up = {"library": "lib", "path": "1 -> 2", "lane": "x", "grade": "B", "effective_grade": None, "transitive": False, "parent": None, "affected_app_classes": ["my.A"], "affected_app_classes_changed": [], "confidence": {"evidence": "direct", "signed_off": True}}
    return {"app": "app", "project_grade": "B", "shrink_allowed": True, "upgrades": [up], "obligations": [dict(o) for o in scan.OBLIGATIONS]} | more


def test_plan_of_tests_in_every_mode(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    suite, covers, tagged = f([("ATest",), ("BTest",), ("GateIT",)], "test string"), f([("ATest", "my.A"), ("BTest", "my.B"), ("GateIT", "my.C")], "test string, cls string"), f([("upgrade-gate", "GateIT")], "tag string, test string")
    plan = lambda load=None, suite=suite, covers=covers, age=3, tags=tagged: reports.plan_tests(spark, load or payload(), suite, covers, {"build": "7", "sha": "s", "age_commits": age}, tags, "head")
    made = plan()
    assert made["report"]["mode"] == "TARGETED" and made["report"]["totals"] == {"suite": 3, "selected": 1, "mandatory_appended": 1, "final": 2}
    assert [e["test"] for e in made["report"]["skipped"]] == ["BTest"] and made["gate"]["build_stage"]["mandatory_verified"] == ["GateIT"]
    assert [o["id"] for o in made["gate"]["obligations_downstream"]] == ["canary", "rollback-path"] and made["gate"]["signoffs"][0]["library"] == "lib"
    for full in (plan(payload(shrink_allowed=False)), plan(age=26), plan(age=None), plan(covers=None)):
        assert full["report"]["mode"] == "FULL" and full["report"]["totals"]["final"] == 3
    assert plan(age=25)["report"]["mode"] == "TARGETED"
    none = plan(suite=suite.limit(0))
    assert none["report"]["mode"] == "REACHABILITY_ONLY" and none["final"].count() == 0 and none["gate"]["obligations_downstream"][0]["note"] == router.NO_SUITE
    with pytest.raises(reports.StaleObligation):
        plan(tags=tagged.limit(0))


def test_merged_scorecards_and_pages():
    entry = lambda lib, grade, new="2", transitive=False: {"library": lib, "transitive": transitive, "recommended": {"grade": grade, "effective_grade": None, "lane": "L" + grade, "old_version": "1", "new_version": new}, "worst": {"grade": grade}}
    card = reports.merge_scorecard(reports.merge_scorecard(None, entry("a", "B")), entry("<b>", "D", transitive=True))
    assert card["project"]["headline_grade"] == "D" and card["project"]["lane_histogram"] == {"LB": {"direct": 1, "transitive": 0}, "LD": {"direct": 0, "transitive": 1}}
    again = reports.merge_scorecard(card, entry("a", "F"))
    assert len(again["libraries"]) == 2 and again["project"]["headline_grade"] == "F"
    page = reports.scorecard_page(card)
    assert page.index("&lt;b&gt;") < page.index("<td>a</td>") and "<b>" not in page
    said = reports.pull_request_comment(card, {"skipped": [{"test": str(i)} for i in range(9)], "totals": {"final": 1, "suite": 10}, "mode": "TARGETED"}, {"methods_passed": 1, "methods_failed": 1, "failed_names": ["x"]})
    assert "1 more" in said and "1 of 10" in said and said.index("| <b> |") < said.index("| a |") and "D" in reports.terminal(card | {"app": "z"})


def test_seal_and_verify(spark, tmp_path):
    pytest.importorskip("cryptography")
    from driftlens.sinks import seals

    path = tmp_path / "a.json"
    path.write_text('{"a": 1}')
    public = seals.seal(str(tmp_path / "key"), [str(path)])
    path.write_text('{ "a" : 1 }')
    assert seals.verify(public, [str(path)]) == {str(path): "verified"}
    path.write_text('{"a": 2}')
    assert seals.verify(public, [str(path)]) == {str(path): "changed"} and seals.verify(public, [str(tmp_path / "b.json")]) == {str(tmp_path / "b.json"): "unsigned"}
