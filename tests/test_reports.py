"""Reports, exports and views on small inputs."""

import json

import pytest

from stratalens.operators import components, evaluation, graph, overview
from stratalens.plans import goldens
from stratalens.sinks import reports
from stratalens.sources import manifest


def test_markdown_and_export(spark, tmp_path):
    c = goldens.corpus(spark)
    found = evaluation.findings(c["facts"], c["declarations"], c["imports"], c["links"], c["roles"], spark.createDataFrame([("g.Sends",)], "class_id string")).cache()
    _, _, parts = goldens.surface_of(spark)
    text = reports.markdown("g", parts, found)
    assert "| `g.Sends` | activity | true | explicit | `g.SIG` (signature\\|privileged) | `g://b.c:8443/x`" in text
    assert "### Severity high (" in text and "`tls-hostname-verifier-accepts-all` (confidence high): `g.Names` in `g/Names.java:4`" in text
    reports.export({"findings": found, "components": parts}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "findings")).count() == found.count()
    assert reports.payload_bytes({"c": parts}) > 500
    with pytest.raises(ValueError):
        reports.within({"c": parts}, 100)
    linked = components.linked(parts, c["declarations"], c["roles"]).cache()
    shared = {r["class"]: (r.name, list(r.declared_as)) for r in components.of_class(linked).collect()}
    assert shared["g.Sends"] == ("g.Alias", ["g.Alias", "g.Sends"])
    assert {r.class_id for r in components.exported_classes(linked).collect()} == {"g.Sends", "g.Hidden"}
    nodes = c["declarations"].selectExpr("id", "package", "kind", "false as external", "'resolved' as resolution", "original_name", "partial", "path")
    s = overview.stats(nodes, c["edges"], found, parts).first()
    assert s.files == len(goldens.CASES) and s.relations == 6 and s.components == 9 and s.exposed == 5 and s.deep_links == 2


def test_difference_and_exit_code(spark):
    changes = spark.createDataFrame([("component-added", "g.A|b", None, "activity")], "kind string, name string, old string, new string")
    assert "| component-added | `g.A\\|b` | — | activity |" in reports.difference("d", changes)
    assert reports.exit_code(changes, "component-added") == 2 and reports.exit_code(changes, "app-flag") == 0 and reports.exit_code(changes, "") == 0
    with pytest.raises(ValueError):
        reports.exit_code(changes, "nothing")


def test_paths_without_edges(spark):
    edges = spark.createDataFrame([], "src string, dst string, kind string, via string, line int, rank int")
    one = spark.createDataFrame([("a",)], "entry string")
    assert graph.search_paths(edges, one, spark.createDataFrame([("b",)], "target string")).collect() == []


def test_root_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "z")], "src string, dst string")
    assert {r.node: r.root for r in overview.root_class(edges).collect()} == {"a": "c", "b": "c", "c": "b", "x": "z", "y": "z"}


def test_locate(tmp_path):
    (tmp_path / "resources").mkdir()
    (tmp_path / "resources" / "AndroidManifest.xml").write_text("<manifest/>")
    assert manifest.locate(str(tmp_path / "sources")).endswith("resources/AndroidManifest.xml") and manifest.locate(str(tmp_path / "x" / "y")) is None
    with pytest.raises(manifest.Refused):
        manifest.locate(str(tmp_path), str(tmp_path / "none.xml"))


def test_refused_manifests_are_rows(spark):
    got = manifest.manifests(spark.createDataFrame([("a", bytearray(b"<a")), ("b", bytearray(b"<manifest package='p'/>"))], "project string, content binary")).collect()
    assert {r.project: (r.error or "")[:3] for r in got} == {"a": "not", "b": ""}


def test_anonymized_lines_keep_no_name(spark):
    names = spark.createDataFrame([("com.shop.Cart", "pkg01.Class0001"), ("com.shop", "pkg01")], "name string, alias string")
    text = 'a\ncom.shop.Cart"com.shop http://Api.shop.io:80/com.shop'
    nodes = spark.createDataFrame([("com.shop.Cart", {"com.shop.Cart": [text]})], "id string, deep map<string, array<string>>")
    out = reports.anonymized({"nodes": nodes.unionByName(nodes), "rules": nodes, "none": nodes.limit(0)}, names)
    got = [r.value for r in out["nodes"].collect()]
    assert len(got) == 2 and len(set(got)) == 1 and out["none"].isEmpty()
    assert json.loads(got[0]) == {"id": "pkg01.Class0001", "deep": {"pkg01.Class0001": ['a\npkg01.Class0001"pkg01 http://host1.invalid:80/pkg01']}}
    assert "com.shop.Cart" in out["rules"].first().value
