import io
import json

from tessella.api import Tools
from tessella.rpc import serve_lines


class Fake(Tools):
    """Tools without a session."""

    def list_namespaces(self, project: str, prefix: str | None = None):
        if project == "none":
            raise LookupError("no project")
        return [f"{project}.{prefix}"]


def test_lines():
    requests = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "list_namespaces", "arguments": {"project": "p", "prefix": "q"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "list_namespaces", "arguments": {"project": "none"}}}, {"id": 5, "method": "other"},
    ]
    out = io.StringIO()
    serve_lines(Fake(None, "d"), io.StringIO("\n".join([*map(json.dumps, requests), "{", ""])), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, None} and got[5]["error"]["code"] == -32601 and got[None]["error"]["code"] == -32700
    tools = {t["name"]: t for t in got[2]["result"]["tools"]}
    assert {"get_schema", "join_files", "run_report", "describe_dataset", "ask", "get_implementations"} <= set(tools)
    assert tools["list_namespaces"]["inputSchema"]["required"] == ["project"]
    assert json.loads(got[3]["result"]["content"][0]["text"]) == ["p.q"] and got[4]["result"]["isError"]
