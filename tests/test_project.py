"""A whole project: index, changes and the command line."""

import json

from stratalens import __main__ as command
from stratalens import project

_MANIFEST = """<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="g"><uses-sdk android:minSdkVersion="24" android:targetSdkVersion="30"/>%s
<application android:debuggable="%s"><activity android:name=".Main" android:exported="%s"/>%s</application></manifest>"""
_MAIN = 'package g;\nimport javax.crypto.Cipher;\npublic class Main extends android.app.Activity {\n  Object seal() throws Exception { return Cipher.getInstance("%s"); }\n}\n'


def _write(top, manifest, files):
    (top / "resources" / "res" / "values").mkdir(parents=True)
    (top / "resources" / "AndroidManifest.xml").write_text(manifest)
    (top / "resources" / "res" / "values" / "bools.xml").write_text("<resources><bool name='open'>true</bool></resources>")
    for name, text in files.items():
        (top / name).write_text(text)
    return str(top)


def _versions(tmp_path):
    old = _write(tmp_path / "old", _MANIFEST % ("", "false", "false", ""), {"Main.java": _MAIN % "AES/GCM/NoPadding", "a.java": 'package o; class a { static final String K = "k"; }'})
    new = _write(tmp_path / "new", _MANIFEST % ('<uses-permission android:name="p.NET"/>', "true", "@bool/open", '<service android:name=".Serve"/>'),
                 {"Main.java": _MAIN % "AES/ECB/X", "b.java": 'package o; class b { static final String K = "k"; }'})
    return old, new


def test_changes(spark, tmp_path):
    old, new = (project.index(spark, p) for p in _versions(tmp_path))
    got = {(r.kind, r.name): (r.old, r.new, sorted(r.triggers)) for r in project.changes(old, new).collect()}
    assert got == {
        ("app-flag", "debuggable"): ("false", "true", ["app-flag"]), ("permission-added", "p.NET"): (None, None, ["permission-added"]),
        ("component-added", "g.Serve"): (None, "service, exported=false", ["component-added"]),
        ("exported-changed", "g.Main"): ("false", "unknown (guess true)", []),
        ("finding-added", "crypto-ecb-mode in g.Main"): (None, got["finding-added", "crypto-ecb-mode in g.Main"][1], ["finding-added"]),
        ("possible-rename", "o.a -> o.b"): (None, "medium", [])}
    assert project.changes(old, old).isEmpty()
    s = new["stats"].first()
    assert s.types == 2 and s.components == 2 and s.findings == 1


def test_command_line(spark, tmp_path, capsys):
    old, new = _versions(tmp_path)
    assert command.main(["diff", old, new, "--fail-on", "finding-added"]) == 2 and "| possible-rename | `o.a -> o.b`" in capsys.readouterr().out
    assert command.main(["export", new, "--format", "json", "--anonymize", "--out", str(tmp_path / "out")]) == 0
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "declarations")).collect()]
    assert {(x["id"], x["name"], x["path"]) for x in lines} == {("pkg01.Class0001", "Class0001", "Class0001.java"), ("pkg02.Class0002", "b", "Class0002.java")}
    assert not [r.value for name in ("findings", "edges", "components") for r in spark.read.text(str(tmp_path / "out" / name)).collect() if "Main" in r.value]
    assert command.main(["export", str(tmp_path / "out")]) == 1
