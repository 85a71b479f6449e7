"""Command line: `python -m tessella.cli COMMAND ...`."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tessella.api import Tools
from tessella.plans import render
from tessella.plans.reports import REPORTS
from tessella.symbols import graph


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("--data-dir", help="where indexed projects are kept")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, /, *positional: str, **options) -> None:
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x)
        for flag, settings in options.items():
            c.add_argument("--" + flag.replace("_", "-"), **settings)

    number, many, flag = {"type": int}, {"action": "append"}, {"action": "store_true"}
    command("schema", "file", max_depth=number | {"default": 10}, format={"choices": ["yaml", "json"], "default": "yaml"})
    command("sample", "file", count=number | {"default": 3}, path={}, entity_type={}, seed=number | {"default": 0}, format={"choices": ["json", "pretty"], "default": "pretty"})
    command("query", "file", select=many, filter=many, limit=number | {"default": 100}, offset=number | {"default": 0}, format={"choices": ["json", "table", "lines"], "default": "json"})
    command("count", "file", filter=many)
    command("group", "file", "path", filter=many, sort={"choices": ["count", "key"], "default": "count"}, limit=number)
    command("stats", "file", "path", filter=many)
    command("distribution", "file", "path", filter=many, buckets=number | {"default": 10})
    command("relationships", "left", "right", min_coverage={"type": float, "default": 50})
    command("join", "left", "right", left_key={}, right_key={}, select=many, filter=many, limit=number | {"default": 100}, group_by={}, aggregate=many)
    command("analyze", "directory", report={"choices": list(REPORTS), "default": "player-kpis"}, format={"choices": ["text", "json"], "default": "text"})
    command("describe", "directory")
    command("type", "project", "type_name", show_deps=flag)
    command("index", "path", name={"required": True}, exclude=many)
    command("projects")
    command("list", "project", prefix={})
    command("search", "project", "query", kind={}, namespace={}, path={}, limit=number | {"default": 50})
    command("project-stats", "project", namespace={})
    command("deps", "project", "symbol", direction={"choices": ["in", "out", "both"], "default": "both"}, depth=number | {"default": 1}, format={"choices": ["json", "tree"], "default": "tree"})
    command("find", "project", kind={}, namespace={}, base={}, has_attribute={}, has_member={}, unity_message=flag, limit=number | {"default": 50})
    command("export", "project", namespace={}, file={}, format={"choices": ["json", "md"], "default": "json"})
    command("context", "project", "task", max_files=number | {"default": 10}, exclude=many)
    command("chat", "project", "question")
    command("serve", port=number | {"default": 3030}, stdio=flag)
    return p


def _markdown(symbols: list[dict]) -> str:
    out = []
    for s in symbols:
        out += [f"## {s['name']}", "", f"{s['kind']} in `{s['file']}:{s['line']}`" + (f", namespace `{s['namespace']}`" if s["namespace"] else ""), ""]
        out += [f"- `{m.get('signature') or m['name']}`" for m in s["members"] or []]
    return "\n".join(out)


def run(argv: list[str], spark: SparkSession | None = None) -> str:
    """What a command prints."""
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessella").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    t = Tools(spark, a.data_dir)
    shown = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    match a.command:
        case "schema":
            out = t.get_schema(a.file, a.max_depth, format=a.format)
            return out if isinstance(out, str) else shown(out)
        case "sample":
            rows = t.sample_data(a.file, a.count, a.path, a.entity_type, a.seed)
            return shown(rows) if a.format == "pretty" else json.dumps(rows, ensure_ascii=False)
        case "query":
            found = t.query_json(a.file, a.select, a.filter, a.limit, a.offset)
            form = {"json": shown, "table": lambda r: render.rows_table(r), "lines": render.rows_lines}[a.format]
            return f"{form(found['rows'])}\n# {found['totalMatched']} of {found['totalScanned']} rows match"
        case "count":
            return shown(t.count_entities(a.file, a.filter))
        case "group":
            return shown(t.group_by(a.file, a.path, a.filter, a.sort, a.limit))
        case "stats":
            return shown(t.get_stats(a.file, a.path, a.filter))
        case "distribution":
            return shown(t.distribution(a.file, a.path, a.buckets, a.filter))
        case "relationships":
            return shown(t.find_relationships(a.left, a.right, a.min_coverage))
        case "join":
            wanted = dict(x.split("=", 1) for x in a.aggregate or []) or None
            return shown(t.join_files(a.left, a.right, a.left_key, a.right_key, a.select, a.filter, a.limit, a.group_by, wanted))
        case "analyze":
            out = t.run_report(a.directory, a.report)
            return shown(out) if a.format == "json" else render.report_text(a.report, out)
        case "describe":
            return shown(t.describe_dataset(a.directory))
        case "type":
            return shown(t.resolve_type(a.project, a.type_name, a.show_deps))
        case "index":
            return shown(t.index_project(a.path, a.name, a.exclude))
        case "projects":
            return shown(t.list_projects())
        case "list":
            return "\n".join(t.list_namespaces(a.project, a.prefix))
        case "search":
            return shown(t.search_symbols(a.project, a.query, a.kind, a.namespace, a.path, a.limit))
        case "project-stats":
            return shown(t.symbol_stats(a.project, a.namespace))
        case "deps":
            out = t.get_dependencies(a.project, a.symbol, a.direction, a.depth)
            return shown(out) if a.format == "json" else graph.format_dependencies(out)
        case "find":
            criteria = {k: getattr(a, k) for k in ("kind", "namespace", "base", "has_attribute", "has_member") if getattr(a, k)}
            return shown(t.find_symbols(a.project, a.limit, **criteria, **({"is_unity_message": True} if a.unity_message else {})))
        case "export":
            out = t.export_symbols(a.project, a.namespace, a.file)
            return shown(out) if a.format == "json" else _markdown(out)
        case "context":
            return shown(t.find_relevant_files(a.project, a.task, a.max_files, a.exclude))
        case "chat":
            return t.ask(a.project, a.question)["answer"]
        case "serve":
            from tessella.rpc import serve_lines
            from tessella.server import serve

            serve_lines(t, sys.stdin, sys.stdout) if a.stdio else serve(t, a.port)
            return ""
    raise AssertionError(a.command)


def main() -> int:
    try:
        print(run(sys.argv[1:]))
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
