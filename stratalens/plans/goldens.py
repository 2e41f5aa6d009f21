"""Queries over a small corpus of Java sources; their SQL states the rows that are right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, diffing, evaluation, hierarchy, inheritance
from ..session import cut_lineage
from ..sources import java, manifest
from .queries import query


def _file(imports: str, body: str, name: str, head: str = "") -> str:
    return "package g;\n" + "".join(f"import {i};\n" for i in imports.split()) + f"public class {name} {head}{{\n{body}\n}}\n"


#: (class, imports, body, what the class extends or implements), and the findings that are right: (rule, confidence).
CASES = [
    ("Ecb", "javax.crypto.Cipher", 'byte[] seal() throws Exception { return Cipher.getInstance("aes").doFinal(); }', "", [("crypto-ecb-mode", "high")]),
    ("Gcm", "javax.crypto.Cipher", 'Object seal() throws Exception { return Cipher.getInstance("AES/GCM/NoPadding"); }', "", []),
    ("Joined", "javax.crypto.Cipher", 'Object seal() throws Exception { return Cipher.getInstance("A" + "ES/ECB/X"); }', "", [("crypto-ecb-mode", "low"), ("crypto-weak-cipher", "low")]),
    ("Rc4", "javax.crypto.Cipher", 'static final String HOW = "RC4"; Object seal() throws Exception { return Cipher.getInstance(HOW); }', "", [("crypto-weak-cipher", "high")]),
    ("Md5", "java.security.MessageDigest", 'Object sum() throws Exception { return MessageDigest.getInstance("SHA1"); }', "", [("crypto-weak-hash", "high")]),
    ("Sha", "java.security.MessageDigest", 'Object sum() throws Exception { return MessageDigest.getInstance("SHA-512"); }', "", []),
    ("Keys", "javax.crypto.spec.*", 'Object key() { return new SecretKeySpec("k3y".getBytes(), "AES"); } Object iv() { return new IvParameterSpec(new byte[]{0, -1, 2}); }', "",
     [("crypto-hardcoded-key", "high"), ("crypto-hardcoded-iv", "high")]),
    ("Fresh", "javax.crypto.spec.IvParameterSpec", "Object iv(byte[] made) { return new IvParameterSpec(made); }", "", []),
    ("Seed", "java.security.SecureRandom", "Object r() { return new SecureRandom(\"x\".getBytes()); } Object s() { return new SecureRandom(); }", "", [("crypto-fixed-seed", "high")]),
    ("Shell", "", 'void go() throws Exception { Runtime.getRuntime().exec(cmd()); new ProcessBuilder("ls").start(); } String cmd() { return "id"; }', "", [("exec-runtime", "high"), ("exec-process-builder", "high")]),
    ("OwnExec", "", "void go(Own o) { o.exec(1); } static class Own { void exec(int i) {} }", "", []),
    ("Loads", "dalvik.system.DexClassLoader", "Object go(String p, ClassLoader up) { return new DexClassLoader(p, p, null, up); }", "", [("exec-dynamic-code-loading", "high")]),
    ("Reflects", "java.lang.reflect.Method", 'Object go(Method m, Object o) throws Exception { Class.forName("a.B"); return m.invoke(o); }', "", [("exec-reflection", "high"), ("exec-reflection", "high")]),
    ("World", "android.content.Context", 'void go(Context c) { c.getSharedPreferences("p", Context.MODE_WORLD_READABLE); c.getDir("d", 2); c.getDir("d", 0); }', "",
     [("storage-world-mode-constant", "medium"), ("storage-world-mode-literal", "low"), ("storage-world-mode-literal", "high")]),
    ("Sql", "android.database.sqlite.SQLiteDatabase", 'SQLiteDatabase db; void go(String id) { db.execSQL("delete from t where id=" + id); this.db.rawQuery("select 1" + " from t", null); }', "", [("sql-concatenation", "high")]),
    ("Pending", "android.app.PendingIntent android.content.*", "void go(Context c, Intent i, int f) { PendingIntent.getService(c, 1, i, 0x8000000); PendingIntent.getActivity(c, 1, i, f); "
     "PendingIntent.getBroadcast(c, 1, i, PendingIntent.FLAG_ONE_SHOT | PendingIntent.FLAG_IMMUTABLE); PendingIntent.getActivity(c, 1, i, PendingIntent.FLAG_ONE_SHOT); }", "",
     [("pendingintent-mutable", "high"), ("pendingintent-mutable", "low"), ("pendingintent-mutable", "high")]),
    ("Sends", "android.app.Activity android.content.Intent", "class In { void go(Intent i) { sendBroadcast(i); sendBroadcast(i, \"p.P\"); } } void on() { getIntent().getStringExtra(\"a\"); }", "extends Activity ",
     [("untrusted-intent-input", "medium")]),
    ("Hidden", "android.app.Activity android.content.Intent", "void on(Intent i) { i.getStringExtra(\"a\"); }", "extends Activity ", []),
    ("Trusts", "javax.net.ssl.*", "Object all() { return new X509TrustManager() { public void checkServerTrusted(Object[] c, String a) { } public void checkClientTrusted(Object[] c, String a) { } }; }", "",
     [("tls-trustmanager-accepts-all", "high")]),
    ("Names", "javax.net.ssl.HostnameVerifier", "public boolean verify(String h, Object s) { return true; }", "implements HostnameVerifier ", [("tls-hostname-verifier-accepts-all", "high")]),
    ("Checks", "javax.net.ssl.HostnameVerifier", 'public boolean verify(String h, Object s) { return "a.b".equals(h); }', "implements HostnameVerifier ", []),
    ("Proceeds", "android.webkit.WebViewClient", "public void onReceivedSslError(Object v, H h, Object e) { h.proceed(); } static class H { void proceed() {} }", "extends WebViewClient ", [("tls-webview-ssl-error-proceed", "high")]),
    ("Cancels", "android.webkit.WebViewClient", "public void onReceivedSslError(Object v, H h, Object e) { h.cancel(); } static class H { void cancel() {} }", "extends WebViewClient ", []),
    ("Legacy", "javax.net.ssl.SSLContext", 'void go() throws Exception { SSLContext.getInstance("sslv3"); SSLContext.getInstance("TLSv1.3"); }', "", [("tls-legacy-protocol", "high")]),
    ("Web", "android.webkit.WebView android.webkit.WebSettings", 'void go(WebView w, WebSettings s, String u) { s.setJavaScriptEnabled(true); s.setAllowFileAccess(false); w.getSettings().setAllowFileAccess(true); '
     's.setAllowFileAccessFromFileURLs(true); s.setAllowUniversalAccessFromFileURLs(true); WebView.setWebContentsDebuggingEnabled(true); w.addJavascriptInterface(this, "b"); w.loadUrl(u); w.loadUrl("https://a.b/"); }', "",
     [("webview-javascript-enabled", "high"), ("webview-file-access", "medium"), ("webview-file-access-from-file-urls", "high"), ("webview-universal-access-from-file-urls", "high"),
      ("webview-debugging-enabled", "high"), ("webview-javascript-interface", "high"), ("webview-loadurl-dynamic", "high")]),
    ("Shadowed", "android.webkit.WebSettings", "WebSettings s; void go() { Own s = new Own(); s.setJavaScriptEnabled(true); { WebSettings t = null; } } static class Own { void setJavaScriptEnabled(boolean b) {} }", "", []),
    ("Lambda", "", "void go() { Use f = x -> x.setJavaScriptEnabled(true); }", "", [("webview-javascript-enabled", "low")]),
    ("Many", "javax.crypto.Cipher", "void go() throws Exception { " + 'Cipher.getInstance("DES/CBC/X"); ' * 25 + "}", "", [("crypto-weak-cipher", "high")] * 20),
]
_EXTRA = [("Sends.In", "broadcast-without-permission", "high")]


def corpus(spark: SparkSession) -> dict[str, DataFrame]:
    """Declarations, facts, imports, edges, links and roles of the cases."""
    rows = [(f"g/{name}.java", _file(imports, body, name, head)) for name, imports, body, head, _ in CASES]
    parsed = cut_lineage(java.parsed(spark.createDataFrame(rows, "path string, content string")))
    out = {x: java.entity(parsed, x) for x in ("declarations", "refs", "facts", "imports")}
    project = out["declarations"].select("id")
    out["edges"] = cut_lineage(inheritance.edges(out["refs"], out["declarations"], out["imports"]))
    out["links"] = cut_lineage(hierarchy.parent_links(out["edges"], project))
    out["roles"] = hierarchy.project_roles(out["links"], project)
    return out


def _values(rows: list[tuple], columns: str) -> str:
    text = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) as t({columns})"


_FOUND = [(f"g.{name}", rule, confidence) for name, _, _, _, right in CASES for rule, confidence in right] + [(f"g.{c}", r, k) for c, r, k in _EXTRA]


@query(_values(_FOUND, "class_id, rule, confidence"))
def java_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark)
    exposed = spark.createDataFrame([("g.Sends",)], "class_id string")
    return evaluation.findings(c["facts"], c["declarations"], c["imports"], c["links"], c["roles"], exposed).select("class_id", "rule", "confidence")


@query(_values([("g.Sends", "extends", "Activity", "android.app.Activity", "external"), ("g.Hidden", "extends", "Activity", "android.app.Activity", "external"),
                ("g.Names", "implements", "HostnameVerifier", "javax.net.ssl.HostnameVerifier", "external"), ("g.Checks", "implements", "HostnameVerifier", "javax.net.ssl.HostnameVerifier", "external"),
                ("g.Proceeds", "extends", "WebViewClient", "android.webkit.WebViewClient", "external"), ("g.Cancels", "extends", "WebViewClient", "android.webkit.WebViewClient", "external")],
               "source, kind, reference, target, resolution"))
def java_inheritance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark)["edges"].select("source", "kind", "reference", "target", "resolution")


@query(_values([("activity", "g.Sends", 3, 1), ("activity", "g.Hidden", 3, 1), ("hostname_verifier", "g.Names", 3, 1), ("hostname_verifier", "g.Checks", 3, 1),
                ("webview_client", "g.Proceeds", 3, 1), ("webview_client", "g.Cancels", 3, 1)], "role, node, confidence, depth"))
def java_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark)["roles"].select("role", "node", "confidence", "depth")


@query(_values([("android.app.ListActivity", "activity"), ("com.google.firebase.messaging.FirebaseMessagingService", "service"), ("javax.net.ssl.X509ExtendedTrustManager", "trust_manager"),
                ("java.io.Externalizable", "serializable"), ("androidx.core.content.FileProvider", "provider")], "type, roles"))
def framework_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame([(t,) for t in ("android.app.ListActivity", "com.google.firebase.messaging.FirebaseMessagingService", "javax.net.ssl.X509ExtendedTrustManager",
                                                  "java.io.Externalizable", "androidx.core.content.FileProvider", "java.lang.Object")], "type string")
    links = hierarchy.framework_types(spark).select(F.col("id").alias("child"), F.explode("parents").alias("parent"))
    return hierarchy.roles_of(types, hierarchy.ancestors(links)).select("type", F.array_join("roles", ",").alias("roles"))


_MANIFEST = b"""<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="g"><uses-sdk android:minSdkVersion="24" android:targetSdkVersion="33"/>
<uses-permission android:name="p.NET"/><permission android:name="g.SIG" android:protectionLevel="signature|privileged"/><permission android:name="g.LOW"/>
<application android:permission="g.LOW" android:name=".App" android:debuggable="@bool/dev">
<activity android:name=".Sends" android:exported="true" android:permission="g.SIG"><intent-filter android:autoVerify="true"><action android:name="android.intent.action.VIEW"/>
<category android:name="android.intent.category.BROWSABLE"/><data android:scheme="https" android:host="b.c" android:port="8443"/><data android:scheme="g" android:path="/x"/></intent-filter></activity>
<activity-alias android:name="Alias" android:targetActivity=".Sends" android:exported="true"/>
<activity android:name=".Hidden"><intent-filter><action android:name="a.GO"/></intent-filter></activity>
<activity android:name="g.Maybe" android:exported="@bool/open"><intent-filter><action android:name="a.GO"/></intent-filter></activity>
<activity android:name="g.Lost" android:exported="@bool/none"/>
<service android:name=".Serve" android:exported="@bool/mixed" android:enabled="false"><intent-filter/></service>
<receiver android:name=".Names"><intent-filter/></receiver>
<provider android:name=".Give" android:exported="true" android:readPermission="g.SIG"/>
<provider android:name=".Keep" android:permission="x.OTHER"/></application></manifest>"""
_BOOLS = {"default": b"<resources><bool name='open'>true</bool><bool name='mixed'>false</bool><bool name='dev'>true</bool></resources>", "v30": b"<resources><bool name='mixed'> true </bool></resources>"}


def surface_of(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifests, bools, components) of the small application."""
    rows = manifest.manifests(spark.createDataFrame([("g", bytearray(_MANIFEST))], "project string, content binary"))
    values = manifest.bools(spark.createDataFrame([("g", q, bytearray(c)) for q, c in _BOOLS.items()], "project string, qualifier string, content binary"))
    return rows, values, components.components(manifest.component_rows(rows), values)


@query(_values([
    ("activity", "g.Sends", "true", None, "high", "true", "g.SIG", "component", "signature|privileged", 2, "g://b.c:8443/x,https://b.c:8443/x"),
    ("activity-alias", "g.Alias", "true", None, "high", "true", None, None, None, 0, ""),
    ("activity", "g.Hidden", "inconsistent", True, "low", "true", "g.LOW", "application", "normal", 4, ""),
    ("activity", "g.Maybe", "unknown", True, "low", "true", "g.LOW", "application", "normal", 4, ""),
    ("activity", "g.Lost", "unknown", False, "low", "true", "g.LOW", "application", "normal", 6, ""),
    ("service", "g.Serve", "unknown", True, "low", "false", "g.LOW", "application", "normal", 14, ""),
    ("receiver", "g.Names", "false", None, "high", "true", "g.LOW", "application", "normal", 7, ""),
    ("provider", "g.Give", "true", None, "high", "true", "g.SIG / g.LOW", "component", "normal", 1, ""),
    ("provider", "g.Keep", "false", None, "high", "true", "x.OTHER", "component", "unknown", 7, "")],
    "type, name, exported, guess, confidence, enabled, permission, permission_source, protection_level, exposure, links"))
def manifest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface_of(spark)[2].select("type", "name", "exported", "guess", "confidence", "enabled", "permission", "permission_source", "protection_level", "exposure",
                                       F.array_join(F.transform("deep_links", lambda d: d["uri"]), ",").alias("links"))


@query(_values([("g.Sends", "g.Sends", "high"), ("g.Alias", "g.Sends", "high"), ("g.Hidden", "g.Hidden", "high"), ("g.Maybe", None, None), ("g.Lost", None, None), ("g.Serve", None, None),
                ("g.Names", "g.Names", "missing"), ("g.Give", None, None), ("g.Keep", None, None)], "name, class, role_check"))
def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark)
    return components.linked(surface_of(spark)[2], c["declarations"], c["roles"]).select("name", "class", "role_check")


@query(_values([("debuggable", "unknown", True), ("allowBackup", None, None), ("usesCleartextTraffic", None, None), ("testOnly", None, None), ("enabled", None, None)], "flag, value, guess"))
def application_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, values, _ = surface_of(spark)
    return components.app_flags(rows, values).select("flag", "value", "guess")


#: Two versions of a project; in the second, o.a has become o.b, and o.c, which holds nothing telling, o.d.
_SHARED = {
    "m/Main.java": 'package m;\nimport o.*;\npublic class Main extends android.app.Activity {\n  Tool tool = new Tool();\n  void go(Part given) {\n    java.util.List<Part> all = null;\n    for (Part p = null; ; ) { Tool.run(); o.Part.cut(); tool.stop(); }\n  }\n}\n',
    "o/Tool.java": "package o;\n/* JADX INFO: compiled from: Tool.kt */\n/* renamed from: x.y, reason: z */\n@Deprecated(since = \"1\")\npublic class Tool {\n  static void run() { new Tool(); }\n}\n",
    "o/Part.java": "package o;\npublic class Part {\n  static void cut() { String s; m.Main main; }\n}\n"}
_OLD = _SHARED | {"o/a.java": 'package o;\nclass a implements Runnable {\n  static final String KEY = "k1";\n}\n', "o/c.java": "package o;\nclass c {}\n"}
_NEW = _SHARED | {"o/b.java": 'package o;\nclass b implements Runnable {\n  static final String KEY = "k1";\n}\n', "o/d.java": "package o;\nclass d {}\n"}


def _version(spark: SparkSession, files: dict[str, str]) -> dict[str, DataFrame]:
    parsed = cut_lineage(java.parsed(spark.createDataFrame(list(files.items()), "path string, content string")))
    return {x: java.entity(parsed, x) for x in ("declarations", "refs", "facts", "imports")}


@query(_values([("m.Main", "o.Tool", 4), ("m.Main", "o.Part", 7), ("o.Part", "m.Main", 3)], "source, target, line"))
def java_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _version(spark, _OLD)
    return inheritance.uses(v["facts"], v["declarations"], v["imports"])


@query(_values([("m.Main", None, None), ("o.Tool", "x.y", "Tool.kt"), ("o.Part", None, None), ("o.a", None, None), ("o.c", None, None)], "id, original_name, source_file"))
def java_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _version(spark, _OLD)["declarations"].select("id", "original_name", "source_file")


@query(_values([("o.a", "o.b", "medium")], "old_id, new_id, confidence"))
def java_renamed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def prints(files: dict[str, str]) -> DataFrame:
        v = _version(spark, files)
        edges = inheritance.edges(v["refs"], v["declarations"], v["imports"])
        roles = hierarchy.project_roles(cut_lineage(hierarchy.parent_links(edges, v["declarations"].select("id"))), v["declarations"].select("id"))
        none = spark.createDataFrame([], "class_id string, rule string")
        return cut_lineage(diffing.fingerprints(v["declarations"], edges, roles, none, v["facts"].filter("kind = 'constant'").select(F.col("owner").alias("id"), "value")))

    return diffing.renamed_classes(prints(_OLD), prints(_NEW), spark.createDataFrame([("m.Main",)], "id string"))
