"""Exports and reports: every entity as JSON lines, a Markdown report, and the text of a difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import redaction
from ..session import cut_lineage

#: Findings of one severity in the Markdown report; the rest are in the JSON.
LISTED = 200
#: Categories that may end a comparison with exit code 2.
FAIL_ON = ("exported-added", "component-added", "permission-added", "deeplink-added", "app-flag", "finding-added")


def json_rows(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON, null fields left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def anonymized(entities: dict[str, DataFrame], names: DataFrame, exempt: tuple[str, ...] = ("rules",)) -> dict[str, DataFrame]:
    """(value) of each entity: its rows as JSON lines, in which every known name (name, alias) and every host is replaced,
    in keys and values at any depth. Entities in `exempt` keep their words. Hosts count from 1 over all entities, by line.
    """
    lines = {k: json_rows(rows).withColumn("k", F.sha2("value", 256)) for k, rows in entities.items()}
    every = None
    for k in lines:
        if k not in exempt:
            every = lines[k] if every is None else every.unionByName(lines[k])
    if every is None:
        return {k: rows.select("value") for k, rows in lines.items()}
    once = cut_lineage(every.distinct())
    plain = redaction.hosts_replaced(once, "k", "value", cut_lineage(redaction.host_aliases(once, "value", "value")))
    # a name after an escape must not run into its letter; `replaced` takes the marks out
    apart = plain.withColumn("value", F.regexp_replace("value", r"(\\(?:u[0-9A-Fa-f]{4}|[^u]))", "\u0001$1\u0001"))
    new = cut_lineage(redaction.replaced(apart, "k", "value", names))
    return {k: rows.select("value") if k in exempt else rows.select("k").join(new, "k").select("value") for k, rows in lines.items()}


def export(entities: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """One folder of JSON lines for each entity, and the version."""
    write_lines(next(iter(entities.values())).sparkSession, {k: json_rows(rows) for k, rows in entities.items()}, path, version)


def write_lines(spark: SparkSession, lines: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """One folder for the lines (value) of each entity, and the version."""
    for name, rows in lines.items():
        rows.write.mode("overwrite").text(f"{path}/{name}")
    spark.createDataFrame([(version, sorted(lines))], "schema_version int, entities array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/index")


def payload_bytes(entities: dict[str, DataFrame]) -> int:
    """Bytes that an export's lines take."""
    return sum(int(json_rows(rows).agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]) for rows in entities.values())


def within(entities: dict[str, DataFrame], limit: int = 150 << 20) -> None:
    """Raise if an export would be larger than a reader takes at once."""
    size = payload_bytes(entities)
    if size > limit:
        raise ValueError(f"the export has {size} bytes; the limit is {limit}")


def markdown(title: str, components: DataFrame, findings: DataFrame) -> str:
    """The attack surface and the finding candidates as Markdown; the components of one application, at most LISTED findings a severity."""
    cell = lambda c: S.table_cell(F.coalesce(F.col(c).cast("string"), F.lit("—")))
    exported = F.concat(cell("exported"), F.when(F.col("guess").isNotNull(), F.concat(F.lit(" (guess: "), F.col("guess").cast("string"), F.lit(")"))).otherwise(""))
    permission = F.when(F.col("permission").isNull(), "none").otherwise(F.concat(F.lit("`"), cell("permission"), F.lit("` ("), cell("protection_level"), F.lit(")")))
    links = F.when(F.size("deep_links") > 0, F.array_join(F.transform("deep_links", lambda d: F.concat(F.lit("`"), d["uri"], F.lit("`"))), ", ")).otherwise("—")
    line = F.format_string("| `%s` | %s | %s | %s | %s | %s |", cell("name"), F.col("type"), exported, cell("reason"), permission, links)
    out = [f"# {title}", "", "## Attack surface", "", "| Component | Type | Exported | Reason | Permission | Deep links |", "|-|-|-|-|-|-|"]
    out += [r.x for r in components.orderBy("exposure", "type", "name").select(line.alias("x")).collect()]  # a manifest has bounded elements
    out += ["", "## Finding candidates", ""]
    counts = {r.severity: r["count"] for r in findings.groupBy("severity").count().collect()}
    if not counts:
        out += ["No candidate found by the current rules.", ""]
    for severity in reversed(S.SEVERITIES):
        n = counts.get(severity, 0)
        if n:
            item = F.format_string("- `%s` (confidence %s): `%s` in `%s:%d`\n  - Snippet: `%s`", "rule", "confidence", "class_id", "path", "line", F.translate(S.table_cell(F.col("snippet")), "`", "'"))
            rows = findings.filter(F.col("severity") == severity).orderBy("class_id", "line", "rule").limit(LISTED).select(item.alias("x")).collect()
            out += [f"### Severity {severity} ({n})", "", *[r.x for r in rows], *([f"- … {n - LISTED} more in the JSON."] if n > LISTED else []), ""]
    return "\n".join(out)


def difference(title: str, changes: DataFrame) -> str:
    """(kind, name, old, new) as a Markdown table by kind and name."""
    cell = lambda c: S.table_cell(F.coalesce(F.col(c).cast("string"), F.lit("—")))
    rows = changes.orderBy("kind", "name").select(F.format_string("| %s | `%s` | %s | %s |", cell("kind"), cell("name"), cell("old"), cell("new")).alias("x")).collect()
    if not rows:
        return f"# {title}\n\nNo difference.\n"
    return "\n".join([f"# {title}", "", "| Change | Item | Before | After |", "|-|-|-|-|", *[r.x for r in rows], ""])


def wanted_categories(fail_on: str) -> set[str]:
    """The comma-separated categories; an unknown one is an error."""
    wanted = {c.strip() for c in fail_on.split(",") if c.strip()}
    if wanted - set(FAIL_ON):
        raise ValueError(f"unknown categories: {', '.join(sorted(wanted - set(FAIL_ON)))}")
    return wanted


def exit_code(changes: DataFrame, fail_on: str) -> int:
    """2 if a change has one of the comma-separated categories among its triggers (its kind, where it has none), else 0."""
    wanted = wanted_categories(fail_on)
    hit = F.arrays_overlap("triggers", F.array(*map(F.lit, sorted(wanted)))) if "triggers" in changes.columns else F.col("kind").isin(*wanted)
    return 2 if wanted and not changes.filter(hit).limit(1).isEmpty() else 0
