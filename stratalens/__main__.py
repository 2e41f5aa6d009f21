"""Command line: `export` writes a report or the index of a project, `diff` the changes between two."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import project
from .session import cut_lineage
from .sinks import reports
from .sources.manifest import Refused

#: The tables of an exported index.
EXPORTED = ("declarations", "edges", "roles", "uses", "manifest", "flags", "components", "findings", "stats")


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="stratalens")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("export", help="a report (md) or the index (json) of a project")
    one.add_argument("path")
    one.add_argument("--format", choices=("md", "json"), default="md")
    one.add_argument("--out", help="file of the report, or folder of the index")
    one.add_argument("--manifest", help="decoded manifest, where it is not beside the sources")
    one.add_argument("--anonymize", action="store_true", help="replace packages, classes and hosts")
    two = commands.add_parser("diff", help="the changes between two versions")
    two.add_argument("old")
    two.add_argument("new")
    two.add_argument("--format", choices=("md", "json"), default="md")
    two.add_argument("--out", help="file of the report, or folder of the rows")
    two.add_argument("--fail-on", default="", help="exit code 2 if one of these is present: " + ", ".join(reports.FAIL_ON))
    args = top.parse_args(argv)
    if args.format == "json" and not args.out:
        top.error("--format json needs --out, a folder")
    if args.command == "export" and args.anonymize and args.format != "json":
        top.error("--anonymize needs --format json")
    return args


def _put(text: str, out: str | None) -> None:
    if out:
        Path(out).write_text(text, encoding="utf-8")
    else:
        print(text)


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    if args.command == "diff":
        reports.wanted_categories(args.fail_on)
    spark = SparkSession.builder.appName("stratalens").getOrCreate()
    try:
        if args.command == "diff":
            found = project.changes(project.index(spark, args.old), project.index(spark, args.new))
            if args.format == "json":
                reports.json_rows(found).write.mode("overwrite").text(args.out)
            else:
                _put(reports.difference("Changes", found), args.out)
            return reports.exit_code(found, args.fail_on)
        t = project.index(spark, args.path, args.manifest)
        if args.format == "md":
            _put(reports.markdown(Path(args.path).resolve().name, t["components"], t["findings"]), args.out)
        else:
            chosen = {k: t[k] for k in EXPORTED}
            if args.anonymize:
                names = cut_lineage(project.aliases(t))
                lines = reports.anonymized(project.without_paths(chosen, names), names)
            else:
                lines = {k: reports.json_rows(v) for k, v in chosen.items()}
            reports.write_lines(spark, lines, args.out)
    except (Refused, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
