"""Hardened reader of decoded manifests: no document type, entities or external parts; bounded size, depth and elements."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

MAX_BYTES = 4 << 20
MAX_DEPTH = 64
MAX_ELEMENTS = 50_000
_AXML = b"\x03\x00\x08\x00"
MAX_RESOURCE_BYTES = 2 << 20
MAX_FILTERS = 200
KINDS = ("activity", "activity-alias", "service", "receiver", "provider")


class Refused(ValueError):
    """The input is not read."""


@dataclass
class Component:
    type: str
    name: str
    line: int
    exported: str | None
    enabled: str | None
    permission: str | None
    target_activity: str | None
    read_permission: str | None = None
    write_permission: str | None = None
    authorities: str | None = None
    filters: list[dict] = field(default_factory=list)


@dataclass
class Manifest:
    package: str = ""
    min_sdk: int | None = None
    target_sdk: int | None = None
    permissions: list[str] = field(default_factory=list)
    levels: dict[str, str] = field(default_factory=dict)
    application: dict[str, str] = field(default_factory=dict)
    components: list[Component] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def _int(x: str | None) -> int | None:
    return int(x) if x and x.isdigit() else None


def parse(raw: bytes) -> Manifest:
    if len(raw) > MAX_BYTES:
        raise Refused("too large")
    if raw.startswith(_AXML):
        raise Refused("binary manifest: decode it first")
    out, path, seen = Manifest(), [], 0
    p = expat.ParserCreate(namespace_separator=" ")

    def refuse(*_: object) -> None:
        raise Refused("document type or entity")

    def start(tag: str, attributes: dict[str, str]) -> None:
        nonlocal seen
        seen += 1
        path.append(tag)
        if len(path) > MAX_DEPTH or seen > MAX_ELEMENTS:
            raise Refused("too deep" if len(path) > MAX_DEPTH else "too many elements")
        a = {k.rsplit(" ", 1)[-1]: v for k, v in attributes.items()}
        if tag == "manifest":
            out.package = a.get("package", "")
        elif tag == "uses-sdk":
            out.min_sdk, out.target_sdk = _int(a.get("minSdkVersion")), _int(a.get("targetSdkVersion"))
        elif tag == "uses-permission" and "name" in a:
            out.permissions.append(a["name"])
        elif tag == "permission" and "name" in a:
            out.levels[a["name"]] = a.get("protectionLevel", "normal")
        elif tag == "application":
            if out.application:
                out.warnings.append("several application elements")
            out.application = a
        elif tag in KINDS and path[-2:-1] == ["application"]:
            if not a.get("name"):
                out.warnings.append(f"component without a name at line {p.CurrentLineNumber}")
            else:
                out.components.append(Component(tag, a["name"], p.CurrentLineNumber, a.get("exported"), a.get("enabled"), a.get("permission"), a.get("targetActivity"),
                                                a.get("readPermission"), a.get("writePermission"), a.get("authorities")))
        elif tag == "intent-filter" and out.components and path[-2] in KINDS:
            out.components[-1].filters.append({"actions": [], "categories": [], "data": [], "auto_verify": a.get("autoVerify") == "true", "line": p.CurrentLineNumber})
        elif path[-2:-1] == ["intent-filter"] and out.components and out.components[-1].filters:
            f = out.components[-1].filters[-1]
            if tag in ("action", "category") and "name" in a:
                f["actions" if tag == "action" else "categories"].append(a["name"])
            elif tag == "data":
                f["data"].append(a)

    p.StartElementHandler, p.EndElementHandler = start, lambda _: path.pop()
    p.StartDoctypeDeclHandler = p.EntityDeclHandler = p.ExternalEntityRefHandler = refuse
    try:
        p.Parse(raw, True)
    except expat.ExpatError as e:
        raise Refused(f"not well-formed: {e}") from None
    return out


def locate(root: str, explicit: str | None = None) -> str | None:
    """The manifest of an export: the explicit path, else the usual places; links and other non-files do not count."""
    fine = lambda p: p.is_file() and not p.is_symlink()
    if explicit:
        if not fine(Path(explicit)):
            raise Refused(f"not a regular file: {explicit}")
        return str(Path(explicit).resolve())
    top = Path(root)
    places = (top / "resources", top.parent / "resources", top)
    return next((str((p / "AndroidManifest.xml").resolve()) for p in places if fine(p / "AndroidManifest.xml")), None)


def bool_values(raw: bytes) -> dict[str, str]:
    """name -> text of each bool of a resource file."""
    if len(raw) > MAX_RESOURCE_BYTES:
        raise Refused("too large")
    out, now, p = {}, [None, ""], expat.ParserCreate()

    def refuse(*_: object) -> None:
        raise Refused("document type or entity")

    def start(tag: str, a: dict[str, str]) -> None:
        now[:] = [a.get("name") if tag == "bool" else None, ""]

    def end(tag: str) -> None:
        if now[0]:
            out[now[0]] = now[1].strip()
        now[0] = None

    def text(t: str) -> None:
        now[1] += t

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    p.StartDoctypeDeclHandler = p.EntityDeclHandler = p.ExternalEntityRefHandler = refuse
    try:
        p.Parse(raw, True)
    except expat.ExpatError as e:
        raise Refused(f"not well-formed: {e}") from None
    return out


_DATA = "scheme string, host string, port string, path string, pathPrefix string, pathPattern string, pathSuffix string, pathAdvancedPattern string, mimeType string"
_FILTER = f"actions array<string>, categories array<string>, data array<struct<{_DATA}>>, auto_verify boolean, line int"
_COMPONENT = ("ord int, type string, name string, line int, exported string, enabled string, permission string, target_activity string, read_permission string, write_permission string, "
              f"authorities string, filters array<struct<{_FILTER}>>")
MANIFESTS = (f"project string, error string, sha256 string, package string, min_sdk int, target_sdk int, permissions array<string>, levels map<string,string>, "
             f"application map<string,string>, components array<struct<{_COMPONENT}>>, warnings array<string>")


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def manifests(files: DataFrame) -> DataFrame:
    """One row of MANIFESTS for each (project, content); `error` says why one was refused."""
    ship(files.sparkSession)
    schema = _arrow(MANIFESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.to_pylist():
                row = {"project": file["project"], "sha256": hashlib.sha256(file["content"]).hexdigest()}
                try:
                    m = parse(file["content"])
                except Refused as e:
                    rows.append(row | {"error": str(e)})
                    continue
                warned = [f"{c.name}: {len(c.filters)} intent-filters; only {MAX_FILTERS} analysed" for c in m.components if len(c.filters) > MAX_FILTERS]
                components = [vars(c) | {"ord": i, "filters": c.filters[:MAX_FILTERS]} for i, c in enumerate(m.components)]
                rows.append(row | {"package": m.package, "min_sdk": m.min_sdk, "target_sdk": m.target_sdk, "permissions": sorted(set(m.permissions)), "levels": list(m.levels.items()),
                                   "application": list(m.application.items()), "components": components, "warnings": m.warnings + warned})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("project", "content").mapInArrow(run, MANIFESTS)


def bools(files: DataFrame) -> DataFrame:
    """(project, name, qualifier, value) from (project, qualifier, content); files that are refused give no rows."""
    ship(files.sparkSession)
    ddl = "project string, name string, qualifier string, value string"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f in batch.to_pylist():
                try:
                    rows += [{"project": f["project"], "name": n, "qualifier": f["qualifier"], "value": v} for n, v in bool_values(f["content"]).items()]
                except Refused:
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("project", "qualifier", "content").mapInArrow(run, ddl)


def component_rows(rows: DataFrame) -> DataFrame:
    """One row for each component, with its application's columns."""
    own = [c.split()[0] for c in ("project", "package", "min_sdk", "target_sdk", "levels", "application")]
    return rows.select(*own, F.explode("components").alias("c")).select(*own, "c.*")
