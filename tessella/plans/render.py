"""Text forms of small results."""

from __future__ import annotations

import json

from tessella.plans.discovery import SchemaNode


def schema_yaml(node: SchemaNode, indent: int = 0) -> str:
    pad, out = "  " * indent, []
    for name, child in node.properties.items():
        out.append(f"{pad}{name}{'?' if child.optional else ''}: {_head(child)}")
        inner = schema_yaml(child.items if child.type == "array" and child.items else child, indent + 1)
        if inner:
            out.append(inner)
    if not node.properties and node.items and indent == 0:
        out.append(schema_yaml(node.items, indent))
    return "\n".join(out)


def _head(node: SchemaNode) -> str:
    if node.type == "array":
        low, high = node.array_length or (0, 0)
        of = f" of {node.items.type}" if node.items else ""
        return f"array[{low}-{high}]{of}"
    text = node.type + (f" <{node.clr_type}>" if node.clr_type else "") + (f" ({node.pattern})" if node.pattern else "")
    return text + (" (e.g. " + ", ".join(json.dumps(x, ensure_ascii=False) for x in node.examples) + ")" if node.examples else "")


def schema_json(node: SchemaNode) -> str:
    return json.dumps(node.to_json(), indent=2, ensure_ascii=False)


def plain(value):
    """Rows, variants and timestamps as JSON values."""
    if hasattr(value, "toPython"):
        return plain(value.toPython())
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def rows_json(rows: list) -> str:
    return json.dumps([plain(r) for r in rows], indent=2, ensure_ascii=False)


def rows_lines(rows: list) -> str:
    return "\n".join(json.dumps(plain(r), ensure_ascii=False) for r in rows)


def rows_table(rows: list) -> str:
    """Columns padded to their longest value."""
    shown = [{k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in plain(r).items()} for r in rows]
    if not shown:
        return "(no rows)"
    names = list(shown[0])
    width = {n: max(len(n), *(len(r.get(n, "")) for r in shown)) for n in names}
    line = lambda r: " | ".join(r.get(n, "").ljust(width[n]) for n in names).rstrip()
    return "\n".join([line({n: n for n in names}), "-+-".join("-" * width[n] for n in names), *(line(r) for r in shown)])


def truncated(value, max_text: int = 100, max_depth: int = 3, depth: int = 0):
    """A value for display: long texts end in `...`, what lies deeper is named by its kind."""
    if isinstance(value, str):
        return value if len(value) <= max_text else value[:max_text] + "..."
    if isinstance(value, list):
        return f"[Array({len(value)})]" if depth >= max_depth else [truncated(x, max_text, max_depth, depth + 1) for x in value]
    if isinstance(value, dict):
        return "{Object}" if depth >= max_depth else {k: truncated(v, max_text, max_depth, depth + 1) for k, v in value.items()}
    return value


def report_text(name: str, report) -> str:
    """A report as indented `key: value` lines."""
    out = [f"=== {name} ==="]

    def walk(value, pad: str) -> None:
        items = value.items() if isinstance(value, dict) else enumerate(value)
        for k, v in items:
            if isinstance(v, (dict, list)):
                out.append(f"{pad}{k}:")
                walk(v, pad + "  ")
            else:
                out.append(f"{pad}{k}: {v}")

    walk(report, "")
    return "\n".join(out)
