"""The tools over standard input and output: one JSON-RPC request a line, one reply a line."""

from __future__ import annotations

import inspect
import json
from typing import IO

from tessella.api import Tools


def _describe(tools: Tools, name: str) -> dict:
    """A tool's name and arguments."""
    parameters = inspect.signature(getattr(tools, name)).parameters.values()
    named = [p for p in parameters if p.kind is not p.VAR_KEYWORD]
    return {
        "name": name,
        "description": (inspect.getdoc(getattr(tools, name)) or name.replace("_", " ")).splitlines()[0],
        "inputSchema": {"type": "object", "properties": {p.name: {} for p in named}, "required": [p.name for p in named if p.default is p.empty]},
    }


def reply(tools: Tools, request: dict) -> dict | None:
    """The reply to a request; None to a notification."""
    method, params, number = request.get("method"), request.get("params") or {}, request.get("id")
    if number is None:
        return None
    result: dict | None = None
    if method == "initialize":
        result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tessella", "version": "1"}}
    elif method == "tools/list":
        result = {"tools": [_describe(tools, n) for n in tools.names()]}
    elif method == "tools/call":
        out = tools.call(params.get("name", ""), **(params.get("arguments") or {}))
        failed = "error" in out
        text = f"Error: {out['error']}" if failed else json.dumps(out["result"], indent=2, ensure_ascii=False, default=str)
        result = {"content": [{"type": "text", "text": text}], "isError": failed}
    elif method == "ping":
        result = {}
    if result is None:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"Unknown method: {method}"}}
    return {"jsonrpc": "2.0", "id": number, "result": result}


def serve_lines(tools: Tools, source: IO[str], sink: IO[str]) -> None:
    """Answer until the input ends; a line that is no JSON gets a parse error."""
    for line in source:
        if not line.strip():
            continue
        try:
            out = reply(tools, json.loads(line))
        except ValueError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}
        if out is not None:
            sink.write(json.dumps(out, ensure_ascii=False) + "\n")
            sink.flush()
