"""HTTP: projects, questions, symbols and status as JSON, and any tool by name."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from tessella.api import Tools


def answer(tools: Tools, method: str, path: str, body: dict) -> tuple[int, object]:
    """(status, value) of a request."""
    parts = [unquote(x) for x in path.split("?")[0].strip("/").split("/")]
    match (method, parts):
        case ("GET", ["api", "projects"]):
            out = tools.call("list_projects")
        case ("GET", ["api", "status"]):
            return 200, {"status": "ok", "tools": tools.names()}
        case ("POST", ["api", "ask"]):
            if not body.get("project") or not body.get("question"):
                return 400, {"error": "project and question are needed"}
            out = tools.call("ask", project=body["project"], question=body["question"])
        case ("GET", ["api", "symbol", project, name]):
            out = tools.call("get_symbol", project=project, name=name)
            return (404, out) if "error" in out else (200, out["result"])
        case ("POST", ["api", "tools", name]):
            out = tools.call(name, **body)
        case _:
            return 404, {"error": "Not found"}
    return (500, out) if "error" in out else (200, out["result"])


def make_server(tools: Tools, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                status, value = answer(tools, method, self.path, json.loads(self.rfile.read(size) or b"{}") if size else {})
            except ValueError:
                status, value = 400, {"error": "The body is no JSON"}
            raw = json.dumps(value, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            self._reply("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._reply("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve(tools: Tools, port: int) -> None:
    make_server(tools, port).serve_forever()
