"""Intent flow, redaction, parse cache, notes and streaming re-index on inline rows."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import graph, intents, redaction
from stratalens.sources import cache, java
from stratalens.streaming import reindex

FACT = "ord int, source string, line int, via string, traced boolean, target_type string, target_name string, action string"


@pytest.fixture(scope="module")
def decided(spark):
    facts = spark.createDataFrame([
        (1, "p.A", 3, "startActivity", True, "p.B", ".C", "act"), (2, "p.A", 4, "startActivity", True, "p.Gone", None, None),
        (3, "p.A", 5, "startService", True, None, ".C$D", "act"), (4, "p.A", 6, "startService", True, None, "p.Gone", None),
        (5, "p.B", 7, "sendBroadcast", True, None, None, "act"), (6, "p.B", 8, "sendBroadcast", True, None, None, "other"),
        (7, "p.B", 9, "sendBroadcast", True, None, None, None), (8, "p.B", 10, "sendBroadcast", False, None, None, "act"),
        (9, "p.A", 3, "startActivity", True, "p.B", None, None)], FACT)
    classes = spark.createDataFrame([("p.A",), ("p.B",), ("p.C.D",), ("p.R",)], "id string")
    declared = spark.createDataFrame([("act", "p.R"), ("act", "p.C.D"), ("act", "p.R"), ("other", None)], "action string, class_id string")
    return intents.decided(facts, classes, declared, "p").cache()


def test_intent_edges(decided):
    got = {(r.source, r.target, r.kind, r.line, r.confidence) for r in intents.intent_edges(decided).collect()}
    assert got == {("p.A", "p.B", "launches", 3, 3), ("p.A", "p.C.D", "launches", 5, 2), ("p.B", "p.R", "sends_action", 7, 2), ("p.B", "p.C.D", "sends_action", 7, 2)}
    assert intents.intent_edges(decided).count() == 4


def test_unresolved_intents(decided):
    got = [(r.source, r.line, r.reason, r.total) for r in intents.unresolved(decided).orderBy("line").collect()]
    assert got == [("p.A", 4, "target class not in the sources", 2), ("p.A", 6, "class name not resolved", 2), ("p.B", 8, "no intent-filter declares this action", 3),
                   ("p.B", 9, "without target or action", 3), ("p.B", 10, "not traceable", 3)]
    assert intents.unresolved(decided, 1).count() == 2


def test_paths_over_the_flow_graph(spark, decided):
    uses = spark.createDataFrame([("p.R", "p.Sink", 2), ("p.R", "p.R", 2)], "source string, target string, line int")
    parts = spark.createDataFrame([("p.A", "activity", "true", None, 1), ("p.B", "service", "unknown", True, 0), ("p.R", "receiver", "false", None, 0)], "class_id string, type string, exported string, guess boolean, links int")
    entries = intents.entry_points(parts)
    assert {(r.entry, r.reasons) for r in entries.collect()} == {("p.A", "deep link, exported"), ("p.B", "perhaps exported")}
    paths = graph.search_paths(intents.flow_graph(intents.intent_edges(decided), uses), entries.select("entry"), spark.createDataFrame([("p.Sink",)], "target string"))
    assert {(r.entry, ">".join(r.nodes), r.confidence) for r in paths.collect()} == {("p.A", "p.A>p.B>p.R>p.Sink", 2), ("p.B", "p.B>p.R>p.Sink", 2)}


def test_redaction(spark):
    declarations = spark.createDataFrame([("com.shop.Cart", "com.shop"), ("com.shop.Cart.Item", "com.shop"), ("a.B", "a")], "id string, package string")
    names = redaction.aliases(declarations, "org.app")
    got = {r.name: r.alias for r in names.collect()}
    assert got == {"com.shop": "pkg02", "org.app": "pkg03", "com.shop.Cart": "pkg02.Class0002", "com.shop.Cart.Item": "pkg02.Class0003"}
    texts = spark.createDataFrame([(1, "see com.shop.Cart$Item, com/shop/Cart.run or xcom.shop; http://Api.Shop.io/x"), (2, "https://b.io http://api.shop.io"), (3, None), (4, "")], "id int, text string")
    new = {r.id: r.text for r in redaction.replaced(texts, "id", "text", names).collect()}
    assert new[1].startswith("see pkg02.Class0003, pkg02.Class0002.run or xcom.shop;") and new[3] is None and new[4] == ""
    assert {(r.host, r.alias) for r in redaction.host_aliases(texts, "id", "text").collect()} == {("api.shop.io", "host1.invalid"), ("b.io", "host2.invalid")}


FILE = "path string, mtime bigint, size bigint, content string"


def test_parse_cache(spark, tmp_path):
    one = spark.createDataFrame([("A.java", 1, 10, "class A {}"), ("B.java", 1, 10, "class B {}")], FILE)
    two = spark.createDataFrame([("A.java", 2, 12, "class A2 {}"), ("B.java", 1, 10, "not read again")], FILE)
    ids = lambda df: sorted(r.id for r in java.entity(df, "declarations").collect())
    assert ids(cache.parsed_with_cache(one, str(tmp_path), "v1")) == ["A", "B"]
    assert ids(cache.parsed_with_cache(two, str(tmp_path), "v1")) == ["A2", "B"]
    assert ids(cache.parsed_with_cache(two.limit(0), str(tmp_path), "v1")) == []


def test_notes(spark, tmp_path):
    at = F.to_timestamp(F.lit("2024-01-01"))
    note = lambda rows: spark.createDataFrame(rows, "project string, node string, status string, text string").withColumn("at", at)
    kept = cache.upsert_notes(note([("p", "A", "open", "x"), ("p", "B", "open", "y")]), note([("p", "A", "done", "z"), ("p", "B", None, ""), ("q", "A", "open", "n")]))
    path = cache.write_notes(kept, str(tmp_path))
    assert {(r.project, r.node, r.status, r.text) for r in spark.read.parquet(path).collect()} == {("p", "A", "done", "z"), ("q", "A", "open", "n")}


def test_streaming_reindex(spark, tmp_path):
    src, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    files = lambda rows: spark.createDataFrame(rows, reindex.FILE).write.mode("append").parquet(src)
    files([("p", "A.java", "class A {}", 1, 10), ("p", "B.java", "class B {}", 1, 10)])
    reindex.reindex(reindex.watch(spark, src), out, point).awaitTermination(60)
    files([("p", "A.java", "class C {}", 2, 10)])
    reindex.reindex(reindex.watch(spark, src), out, point).awaitTermination(60)
    rows = spark.read.parquet(out)
    assert rows.count() == 3
    assert sorted(r.id for r in java.entity(reindex.latest(rows), "declarations").collect()) == ["B", "C"]
