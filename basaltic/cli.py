"""Command line: analyze, impact, metrics, compare."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from basaltic.operators import compare as comparing
from basaltic.operators import impact as impacts
from basaltic.plans.project import analyze_project
from basaltic.sources import git, sinks


def session() -> SparkSession:
    return SparkSession.builder.appName("basaltic").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _days(text: str) -> int | None:
    return None if text == "all" else int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="basaltic", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    scope = argparse.ArgumentParser(add_help=False)
    scope.add_argument("path")
    scope.add_argument("--include", action="append", default=[])
    scope.add_argument("--exclude", action="append", default=[])
    scope.add_argument("--no-gitignore", action="store_true")
    scope.add_argument("--compile-commands")
    history = argparse.ArgumentParser(add_help=False)
    history.add_argument("--churn-days", type=_days, default=365, help="0: none; all: all history")
    a = commands.add_parser("analyze", parents=[scope, history])
    a.add_argument("-o", "--out-dir", default="basaltic-out")
    a.add_argument("--with-defuse", action="store_true")
    a.add_argument("--embed-sources", action="store_true")
    a.add_argument("--json-only", action="store_true")
    a.add_argument("--max-nodes", type=int, default=800)
    i = commands.add_parser("impact", parents=[scope])
    i.add_argument("target", nargs="?", help="FILE:LINE or FILE:START-END")
    i.add_argument("--diff", nargs="?", const="worktree")
    i.add_argument("--depth", type=int, default=impacts.MAX_DEPTH)
    i.add_argument("--json", action="store_true")
    m = commands.add_parser("metrics", parents=[scope, history])
    m.add_argument("--format", choices=["table", "json", "md", "csv"], default="table")
    m.add_argument("--sort-by", choices=sinks.TABLE_COLUMNS, default="path")
    m.add_argument("--top", type=int)
    m.add_argument("--output")
    m.add_argument("--symbols-csv")
    c = commands.add_parser("compare")
    c.add_argument("old_json")
    c.add_argument("new_json")
    c.add_argument("-o", "--out-dir", default="basaltic-out")
    c.add_argument("--json-only", action="store_true")
    return top


def _put(text: str, path: str | None) -> None:
    if not path:
        print(text)
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def _analyzed(args, churn_days):
    return analyze_project(session(), args.path, args.include, args.exclude, not args.no_gitignore, args.compile_commands, churn_days=churn_days)


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: nothing found or unreadable; 2: wrong arguments."""
    args = parser().parse_args(argv)
    if args.command != "compare" and not os.path.isdir(args.path):
        print(f"no such folder: {args.path}", file=sys.stderr)
        return 2
    if args.command == "compare":
        try:
            old, new = (sinks.read_json(session(), p) for p in (args.old_json, args.new_json))
        except (OSError, ValueError) as e:
            print(e, file=sys.stderr)
            return 1
        doc = sinks.compare_document(comparing.compare(old, new))
        sinks.write_json(doc, os.path.join(args.out_dir, "compare.json"))
        if not args.json_only:
            _put(sinks.compare_html(doc), os.path.join(args.out_dir, "compare.html"))
        return 0
    if args.command == "impact":
        target = sinks.parse_target(args.target) if args.target else None
        if (target is None) == (args.diff is None):
            print("give either FILE:LINE[-END] or --diff", file=sys.stderr)
            return 2
        tables = _analyzed(args, 0)
        if target:
            found = impacts.analyze(tables, *target, max_depth=args.depth, root=os.path.abspath(args.path))
        else:
            found = impacts.analyze_diff(tables, git.diff_hunks(args.path, args.diff), args.depth)
        doc = sinks.impact_document(found)
        print(json.dumps(doc, ensure_ascii=False, indent=2) if args.json else sinks.impact_text(doc))
        return int("error" in doc)
    tables = _analyzed(args, args.churn_days)
    if args.command == "metrics":
        _put(sinks.render_table(sinks.metric_table(tables, args.sort_by, args.top)) if args.format == "table" else sinks.export_metrics(tables, args.format), args.output)
        if args.symbols_csv:
            _put(sinks.export_symbols_csv(tables), args.symbols_csv)
        return 0
    doc = sinks.to_document(tables, args.with_defuse)
    doc["metrics"]["ui"] = {"max_nodes": args.max_nodes}
    sinks.write_json(doc, os.path.join(args.out_dir, "analysis.json"))
    if not args.json_only:
        _put(sinks.report_html(tables, doc, args.embed_sources), os.path.join(args.out_dir, "report.html"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
