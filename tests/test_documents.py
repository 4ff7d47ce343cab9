"""Document readers on small files of our own."""

import json

from driftlens.operators import catalog as joins
from driftlens.sources import documents


def write(folder, name, value):
    path = folder / name
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_sbom_catalog_and_bucket(spark, tmp_path):
    sbom = {
        "components": [{"type": "library", "group": "g", "name": "a", "version": "1.2"}, {"name": "b", "version": "2.0", "purl": "pkg:maven/h/b@2.0"}, {"type": "file", "name": "c", "version": "1"}, {"name": "d", "version": ""}],
        "dependencies": [{"ref": "pkg:maven/g/a@1.2", "dependsOn": ["pkg:maven/h/b@2.0"]}, {"ref": "root"}],
    }
    path = write(tmp_path, "s.json", sbom)
    parts = documents.sbom_components(spark, path)
    assert sorted((r.grp, r.artifact, r.version) for r in parts.collect()) == [("g", "a", "1.2"), ("h", "b", "2.0")]
    assert [(r.parent, r.child, r.is_root) for r in documents.sbom_edges(spark, path).collect()] == [("a", "b", False)]
    cat = {"components": [{"group": "g", "name": "a", "version": "1.2.rhlw-00001"}, {"group": "g", "name": "a", "version": "1.2.rhlw-00002"}, {"group": "h", "name": "b", "version": "2.1.redhat-1"}]}
    table = documents.catalog(spark, write(tmp_path, "c.json", cat))
    assert {(r.artifact, r.bucket, r.full_version) for r in joins.bucket(parts, table).collect()} == {("a", "exact", "1.2.rhlw-00002"), ("b", "near", None)}


def test_advisories_skip_what_has_no_fix(spark, tmp_path):
    good = {"id": "x", "summary": "s", "aliases": ["CVE-1", "GHSA"], "affected": [{"package": {"name": "g:a"}, "ranges": [{"type": "E", "events": [{"introduced": "0"}, {"fixed": "1.1"}]}]}]}
    write(tmp_path, "a.json", good)
    write(tmp_path, "b.json", "{broken")
    write(tmp_path, "c.json", {"id": "y"})
    rows = documents.advisories(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("x", "CVE-1", "g:a", "1.1", "s")]


def test_coverage_map_and_tree(spark, tmp_path):
    cover = {"build": "7", "age_commits": 3, "tests": {"T": {"covers": ["a.B", "a.C"]}, "U": {"covers": []}}}
    assert sorted((tuple(r) for r in documents.coverage_map(spark, write(tmp_path, "m.json", cover)).collect()), key=str) == [("T", "a.B", "7", 3), ("T", "a.C", "7", 3), ("U", None, "7", 3)]
    text = "[INFO] app:app:jar:1\n[INFO] +- g.x:a:jar:1.2:compile\n[INFO] |  \\- h:b:jar:linux-x86_64:2.0:runtime\nnoise\n"
    assert sorted(tuple(r) for r in documents.dependency_tree(spark, write(tmp_path, "t.txt", text)).collect()) == [("g.x", "a", "1.2"), ("h", "b", "2.0")]
