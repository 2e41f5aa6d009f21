"""Source readers and name resolution on inline sources."""

import pytest

from stratalens.operators import graph, inheritance
from stratalens.sources import java, manifest

FILES = {
    "a/Base.java": "package a; import android.app.Activity; public abstract class Base extends Activity { static class Inner {} }",
    "a/Main.java": 'package a;\n/* renamed from: o.X */\npublic class Main extends Base implements Runnable, b.Face {\n  class Sub extends Inner {}\n  void run() { web.loadUrl("http://x"); new Thread(r) { public void go() { stop(1, f(2)); } }; }\n}',
    "b/Face.java": "package b; public interface Face extends Missing { enum E { A, B } record R(int x) {} @interface N {} }",
    "b/Bad.java": "package b; class Bad { void x( { } class Good {}",
}


@pytest.fixture(scope="module")
def rows(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    return java.parsed(files).cache()


def test_declarations(rows):
    got = {r.id: r for r in java.entity(rows, "declarations").collect()}
    assert {"a.Base", "a.Base.Inner", "a.Main", "a.Main.Sub", "b.Face", "b.Face.E", "b.Face.R", "b.Face.N", "b.Bad"} <= set(got)
    assert got["a.Base"].abstract and got["b.Face"].kind == "interface" and got["b.Face.R"].kind == "record" and got["b.Face.N"].kind == "annotation"
    assert got["a.Main"].line == 3 and got["a.Main"].end_line == 6 and got["a.Main"].original_name == "o.X"
    assert got["b.Bad"].partial and not got["a.Main"].partial


def test_facts(rows):
    facts = {(r.kind, r.name): r for r in java.entity(rows, "facts").collect()}
    assert facts["call", "loadUrl"].receiver.name == "web" and facts["call", "loadUrl"].receiver.kind == "name" and facts["call", "loadUrl"].args[0].sval == "http://x"
    stop = facts["call", "stop"]
    assert stop.anonymous and stop.anonymous_type == "Thread" and [(a.kind, a.ival) for a in stop.args] == [("int", 1), ("call", None)]


def test_edges_and_roles(rows, spark):
    e = inheritance.edges(*(java.entity(rows, x) for x in ("refs", "declarations", "imports"))).cache()
    got = {(r.source, r.reference): (r.target, r.resolution) for r in e.collect()}
    assert got[("a.Main", "Base")] == ("a.Base", "resolved") and got[("a.Base", "Activity")] == ("android.app.Activity", "external")
    assert got[("a.Main", "b.Face")] == ("b.Face", "resolved") and got[("b.Face", "Missing")] == ("?b.Face::Missing", "unresolved")
    assert got[("a.Main.Sub", "Inner")][1] == "unresolved"
    links = e.selectExpr("source as child", "target as parent", "3 as rank", "1 as ord")
    roles = graph.assign_roles(links, spark.sql("select 'activity' as role, 'android.app.Activity' as type")).collect()
    assert {(r.node, r.depth, r.confidence) for r in roles} == {("a.Base", 1, 3), ("a.Main", 2, 3)}


def test_manifest():
    m = manifest.parse(b'<manifest xmlns:a="u" package="p"><uses-sdk a:minSdkVersion="24" a:targetSdkVersion="30"/><application><activity a:name=".M" a:exported="true">'
                       b'<intent-filter><action a:name="V"/><data a:scheme="s"/></intent-filter></activity><service/></application></manifest>')
    assert m.package == "p" and m.target_sdk == 30 and m.components[0].filters[0]["actions"] == ["V"] and len(m.warnings) == 1


@pytest.mark.parametrize("raw", [b"<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>", b"\x03\x00\x08\x00x", b"<a>" * 70 + b"</a>" * 70, b"<a", b"x" * (5 << 20)])
def test_hostile_manifest(raw):
    with pytest.raises(manifest.Refused):
        manifest.parse(raw)


def test_synthetic_project_resolves(spark):
    from collections import Counter

    from stratalens.sources import synthetic

    rows = list(synthetic.project(300, depth=4))
    assert rows == list(synthetic.project(300, depth=4)) and len(rows) == 300
    parsed = java.parsed(spark.createDataFrame(rows, "path string, content string")).cache()
    e = inheritance.edges(*(java.entity(parsed, x) for x in ("refs", "declarations", "imports")))
    assert set(Counter(r.resolution for r in e.collect())) == {"resolved"}
    links = e.filter("kind = 'extends'").selectExpr("source as src", "target as dst")
    assert graph.ancestor_closure(links).agg({"depth": "max"}).first()[0] <= 3
