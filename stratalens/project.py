"""One project as tables: sources, manifest, findings and the graph put together, and the changes between two of them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import components, diffing, evaluation, hierarchy, inheritance, overview, redaction
from .session import cut_lineage
from .sources import java, manifest

Tables = dict[str, DataFrame]


def index(spark: SparkSession, root: str, manifest_path: str | None = None) -> Tables:
    """All entities of an export. A folder without a manifest has empty manifest tables; one without sources is an error."""
    files = java.read_sources(spark, root)
    if files.isEmpty():
        raise ValueError(f"no .java file below {root}")
    top = Path(root).resolve()
    files = files.withColumn("path", F.regexp_replace("path", r"^(?:file:)?/+", "/")).withColumn("path", F.expr(f"substring(path, {len(str(top)) + 2})"))
    place = manifest.locate(root, manifest_path)
    return tables(files, *_manifest_files(spark, place)) | {"warnings": java.warnings(files)}


def _manifest_files(spark: SparkSession, place: str | None) -> tuple[DataFrame, DataFrame]:
    """(project, content) of the manifest and (project, qualifier, content) of the boolean resources beside it."""
    found, values = [], []
    if place:
        found.append(("", bytearray(Path(place).read_bytes())))
        for folder in sorted((Path(place).parent / "res").glob("values*")):
            file = folder / "bools.xml"
            if file.is_file() and not file.is_symlink() and not folder.is_symlink():
                values.append(("", folder.name.removeprefix("values").lstrip("-") or "default", bytearray(file.read_bytes())))
    return spark.createDataFrame(found, "project string, content binary"), spark.createDataFrame(values, "project string, qualifier string, content binary")


def tables(files: DataFrame, manifests: DataFrame, resources: DataFrame) -> Tables:
    """The entities of source files (path, content), a manifest (project, content) and its boolean resources."""
    parsed = cut_lineage(java.parsed(files.select("path", "content")))
    out = {x: java.entity(parsed, x) for x in ("declarations", "refs", "facts", "imports")}
    project = out["declarations"].select("id")
    out["edges"] = cut_lineage(inheritance.edges(out["refs"], out["declarations"], out["imports"]))
    out["links"] = cut_lineage(hierarchy.parent_links(out["edges"], project))
    out["roles"] = cut_lineage(hierarchy.project_roles(out["links"], project))
    out["uses"] = cut_lineage(inheritance.uses(out["facts"], out["declarations"], out["imports"]))
    out["manifest"], bools = cut_lineage(manifest.manifests(manifests)), cut_lineage(manifest.bools(resources))
    out["flags"] = cut_lineage(components.app_flags(out["manifest"], bools))
    decided = components.components(manifest.component_rows(out["manifest"]), bools)
    out["components"] = cut_lineage(components.linked(decided, out["declarations"], out["roles"]))
    exposed = components.exported_classes(out["components"])
    out["findings"] = cut_lineage(evaluation.findings(out["facts"], out["declarations"], out["imports"], out["links"], out["roles"], exposed))
    strings = out["facts"].filter("kind = 'constant'").select(F.col("owner").alias("id"), "value")
    out["fingerprints"] = cut_lineage(diffing.fingerprints(out["declarations"], out["edges"], out["roles"], out["findings"], strings))
    nodes = out["declarations"].withColumns({"external": F.lit(False), "resolution": F.lit("resolved")})
    out["stats"] = overview.stats(nodes, out["edges"], out["findings"], out["components"])
    return out


def aliases(t: Tables) -> DataFrame:
    """(name, alias) of the project's own packages, classes and simple names, the manifest's package included."""
    first = t["manifest"].select("package").filter("package is not null").first()  # one manifest a project
    return redaction.report_aliases(t["declarations"], first[0] if first else None)


def without_paths(t: Tables, names: DataFrame) -> Tables:
    """The tables with every file named after its first class."""
    first = t["declarations"].groupBy("path").agg(F.min("id").alias("name")).join(names, "name").select("path", F.concat(F.substring_index("alias", ".", -1), F.lit(".java")).alias("_p"))
    return {k: rows.join(first, "path", "left").withColumn("path", F.coalesce("_p", F.lit("file.java"))).drop("_p") if dict(rows.dtypes).get("path") == "string" else rows for k, rows in t.items()}


def _exposure(a: str) -> Column:
    e, guess = F.col(f"{a}.exported"), F.coalesce(F.col(f"{a}.guess").cast("string"), F.lit("none"))
    return F.when(e.isin("unknown", "inconsistent"), F.concat(e, F.lit(" (guess "), guess, F.lit(")"))).when(e == "true", "true").otherwise("false")


def changes(old: Tables, new: Tables) -> DataFrame:
    """(kind, name, old, new, triggers) of the manifests, finding candidates and renamed classes; `triggers` may end a comparison."""
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str | Column, name: Column, before: Column, after: Column, *triggers: Column) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        marks = F.array_compact(F.array(*triggers)) if triggers else F.expr("cast(array() as array<string>)")
        return df.select(kind.alias("kind"), name.alias("name"), before.cast("string").alias("old"), after.cast("string").alias("new"), marks.alias("triggers"))

    has = lambda t: t["manifest"].filter("error is null")
    present = overview.presence(has(old), has(new))
    every = [rows(present, "manifest-presence", F.lit("manifest"), F.col("change") == "removed", F.col("change") == "added")]
    both = has(old).select("project").join(has(new).select("project"), "project")  # versions are compared where both have a manifest
    of = lambda t, name: t[name].join(both, "project", "left_semi")

    apps = diffing.field_changes(of(old, "manifest"), of(new, "manifest"), "project", ["package", "min_sdk", "target_sdk"])
    every.append(rows(apps, "app", F.col("field"), F.col("old"), F.col("new")))
    flags = overview.flag_changes(of(old, "flags"), of(new, "flags"))
    every.append(rows(flags, "app-flag", F.col("flag"), F.col("old"), F.col("new"), F.when(F.col("highlight") & (F.col("flag") != "enabled"), "app-flag")))
    wanted = lambda t: of(t, "manifest").select(F.explode("permissions").alias("p"))
    p = diffing.added_removed(wanted(old), wanted(new), "p")
    every.append(rows(p, F.concat(F.lit("permission-"), F.col("change")), F.col("p"), none, none, F.when(F.col("change") == "added", "permission-added")))

    x = of(old, "components").select("name", F.struct("type", "exported", "guess", "permission", "protection_level", "deep_links", "actions").alias("a"))
    y = of(new, "components").select("name", F.struct("type", "exported", "guess", "permission", "protection_level", "deep_links", "actions").alias("b"))
    j = cut_lineage(x.dropDuplicates(["name"]).join(y.dropDuplicates(["name"]), "name", "full"))
    name, come, gone = F.col("name"), j.filter("a is null"), j.filter("b is null")
    every.append(rows(come, "component-added", name, none, F.concat("b.type", F.lit(", exported="), _exposure("b")), F.lit("component-added"),
                      F.when(F.col("b.exported") == "true", "exported-added"), F.when(F.size("b.deep_links") > 0, "deeplink-added")))
    every.append(rows(gone, "component-removed", name, F.col("a.type"), none))
    stay = j.filter("a is not null and b is not null")
    opened = (F.col("b.exported") == "true") & (F.col("a.exported") != "true")
    every.append(rows(stay.filter(_exposure("a") != _exposure("b")), "exported-changed", name, _exposure("a"), _exposure("b"), F.when(opened, "exported-added")))
    guard = lambda s: F.concat_ws(" ", f"{s}.permission", F.concat(F.lit("("), f"{s}.protection_level", F.lit(")")))
    every.append(rows(stay.filter(guard("a") != guard("b")), "permission-changed", name, guard("a"), guard("b")))
    uris = lambda s: F.transform(F.col(f"{s}.deep_links"), lambda d: d["uri"])
    for s, o, kind, mark in (("b", "a", "deeplink-added", [F.lit("deeplink-added")]), ("a", "b", "deeplink-removed", [])):
        u = stay.select("name", F.explode(F.array_except(uris(s), uris(o))).alias("u"))
        every.append(rows(u, kind, name, F.col("u") if s == "a" else none, F.col("u") if s == "b" else none, *mark))
    said = lambda s: F.array_join(f"{s}.actions", ", ")
    every.append(rows(stay.filter(said("a") != said("b")), "filters-changed", name, said("a"), said("b")))

    keyed = lambda t: t["findings"].select("rule", "class_id", "severity", S.snippet_digest(F.col("snippet")).alias("digest"))
    found = diffing.multiset_difference(keyed(old), keyed(new), ["rule", "class_id", "severity", "digest"])
    more, less = F.col("added") > 0, F.concat(F.col("severity"), F.lit(" x "), F.greatest("added", "removed").cast("string"))
    every.append(rows(found, F.when(more, "finding-added").otherwise("finding-removed"), F.concat("rule", F.lit(" in "), "class_id"), F.when(~more, less), F.when(more, less), F.when(more & F.col("severity").isin("medium", "high"), "finding-added")))
    anchors = old["components"].select(F.col("class_id").alias("id")).unionByName(new["components"].select(F.col("class_id").alias("id"))).filter("id is not null").distinct()
    same = diffing.renamed_classes(old["fingerprints"], new["fingerprints"], anchors)
    every.append(rows(same, "possible-rename", F.concat(F.col("old_id"), F.lit(" -> "), F.col("new_id")), none, F.col("confidence")))
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return cut_lineage(out)
