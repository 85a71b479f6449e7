import json
import random

import pytest

from tessella.operators.dataset import Dataset
from tessella.plans import discovery, render, reports


def write(path, rows):
    path.write_text(json.dumps({"entities": rows}))


def test_id_values_both_backends(spark, entities):
    rows = [{"id": 1, "x": "Player:0A", "plain": "zz", "refs": {"itemIds": ["a", "b", ""]}, "boxed": {"ownerId": {"value": "q"}}, "deep": [{"paid": 5}]}, {"id": 2}]
    want = {("id", "1"), ("id", "2"), ("x", "Player:0A"), ("refs.itemIds[*]", "a"), ("refs.itemIds[*]", "b"), ("boxed.ownerId", "q"), ("deep[*].paid", "5")}
    assert {tuple(r) for r in discovery.id_values(entities(rows)).collect()} == want
    typed = spark.createDataFrame(
        [(1, "Player:0A", "zz", (["a", "b", ""],), (("q",),), [(5,)]), (2, None, None, None, None, None)],
        "id int, x string, plain string, refs struct<itemIds:array<string>>, boxed struct<ownerId:struct<value:string>>, deep array<struct<paid:int>>",
    )
    assert {tuple(r) for r in discovery.id_values(Dataset.table(typed)).collect()} == want


def test_relationships(entities):
    left = entities([{"userId": f"u{i}"} for i in range(10)], "l.json")
    right = entities([{"memberIds": [f"u{i}", f"v{i}"]} for i in range(7)], "r.json")
    found = discovery.find_relationships(left, right).collect()
    assert [(r["left_path"], r["right_path"], r["matched"], r["coverage"], r["kind"]) for r in found] == [("userId", "memberIds[*]", 7, 70.0, "many-to-one")]
    assert not discovery.find_relationships(left, right, 80).collect()


def test_id_forms(spark):
    ids = {"a": ["Player:1", "Player:2"], "b": ["Ab:1", "Bc:2"], "c": ["0123456789abcdef"], "d": ["12", "345"], "e": ["x", "12"]}
    rows = spark.createDataFrame([(k, v) for k, vs in ids.items() for v in vs], "path string, value string")
    got = {r["path"]: (r["n"], r["form"]) for r in discovery.id_fields(None, rows).collect()}
    assert got == {"a": (2, "Player:*"), "b": (2, "EntityId:*"), "c": (1, "hex-id"), "d": (2, "numeric-id"), "e": (2, None)}


def test_schema(entities):
    rows = [{"$type": "Game.Data.Player, Game", "id": "Player:1", "n": 1, "list": [{"a": 1, "b": "x"}, {"a": 2}], "when": "2024-01-01T10:00"}, {"id": "Player:2", "list": [], "n": None}]
    node = discovery.infer_schema(entities(rows))
    assert node.type == "object" and node.clr_type == "Game.Data.Player, Game"
    p = node.properties
    assert p["id"].pattern == "Player:xxx" and not p["id"].optional and p["when"].pattern == "ISO date" and p["when"].optional
    assert p["list"].array_length == (0, 2) and p["list"].items.properties["b"].optional and not p["list"].items.properties["a"].optional
    text = render.schema_yaml(node)
    assert "list: array[0-2] of object" in text and "  b?: string" in text and "when?" in text
    assert json.loads(render.schema_json(node))["properties"]["list"]["arrayLength"] == {"min": 0, "max": 2}
    assert discovery.infer_schema(entities(rows), max_depth=1).properties["list"].items is None


@pytest.fixture(scope="module")
def game(tmp_path_factory):
    """127 players and 210 characters with their logins."""
    rng, folder, day = random.Random(5), tmp_path_factory.mktemp("game"), 86_400_000
    players, spans = [], {}
    for i in range(127):
        n = rng.choice([0, 1, 2, 5])
        times = sorted(1_704_067_200_000 + int(rng.random() * rng.choice([0.5, 2, 10]) * day) for _ in range(n))
        spans[f"Player:{i:x}"] = (times[-1] - times[0]) / day if n else None
        devices = [{"firstLogin": times[0], "lastLogin": times[-1]}] if n else []
        players.append({"entityId": f"Player:{i:x}", "payload": {"characterRoster": {"characterIds": list(range(rng.randint(0, 3)))}, "deviceHistory": devices if i % 2 else {"d": devices[0]} if n else {}, "loginHistory": [{"timestamp": t} for t in times]}})
    chars = [{"entityId": f"PlayerCharacter:{i:x}", "payload": {"playerId": f"Player:{rng.randrange(127):x}", "character": {"characterClassId": rng.choice(["Mage_Class", "Monk_Class"])}, "level": rng.randint(1, 9) if i % 5 else None, "equippedItems": [{"itemLevel": rng.randint(1, 50)}] * rng.randint(0, 3), "gear": [1]}} for i in range(210)]
    write(folder / "live.json", [*players, {"entityId": "Guild:1"}, {"entityId": 5}])
    write(folder / "chars.json", chars)
    return str(folder), players, chars, spans


def test_kpis(spark, game):
    folder, players, chars, _ = game
    out = reports.run_report(spark, folder, "player-kpis")
    sizes = [len(p["payload"]["characterRoster"]["characterIds"]) for p in players]
    assert out["players"] == {"count": 127, "charactersPerPlayer": {"min": min(sizes), "max": max(sizes), "avg": round(sum(sizes) / 127, 2)}}
    assert out["characters"]["count"] == 210 == sum(out["characters"]["classes"].values())


def test_retention(spark, game):
    folder, _, chars, spans = game
    out = reports.run_report(spark, folder, "retention")
    assert out["new"] + out["returning"] == out["total"] == 127
    for n in (1, 3, 7):
        assert out[f"d{n}"]["count"] == sum((s or 0) >= n for s in spans.values())
    assert out["d1"]["count"] >= out["d3"]["count"] >= out["d7"]["count"] and 0 <= out["d1"]["rate"] <= 100
    by = reports.run_report(spark, folder, "retention-by-class")
    for name, row in by.items():
        owners = {c["payload"]["playerId"] for c in chars if c["payload"]["character"]["characterClassId"] == name}
        assert row["total"] == len(owners) and row["d3"]["count"] == sum((spans[o] or 0) >= 3 for o in owners)


def test_progression(spark, game):
    folder, _, chars, _ = game
    out = reports.run_report(spark, folder, "progression")
    levels = [c["payload"]["level"] for c in chars if c["payload"]["level"]]
    assert out["maxLevel"] == max(levels) and out["atMaxLevel"] == levels.count(max(levels)) and sum(out["levels"].values()) == len(levels)
    worn = sum(len(c["payload"]["equippedItems"]) + 1 for c in chars)
    assert out["equipped"]["total"] == worn and out["characters"] == 210
    most = [max((x["itemLevel"] for x in c["payload"]["equippedItems"]), default=0) for c in chars]
    got = reports.average_level(spark, folder)
    assert got["characters"] == 210 and abs(got["average"] - sum(most) / 210) < 1e-9


def test_summaries_and_missing_files(spark, game, tmp_path):
    folder = game[0]
    out = reports.run_report(spark, folder, "schema-summary")
    assert [(r["file"], r["entities"], r["error"]) for r in out] == [("chars.json", 210, None), ("live.json", 129, None)] and "payload" in out[0]["schema"]
    about = discovery.describe_dataset(spark, folder)
    assert [f.count for f in about.files] == [210, 129] and any(r["left_path"] == "payload.playerId" and r["right_path"] == "entityId" for r in about.relationships)
    assert 0 < len(about.suggested_queries) <= 5
    assert reports.run_report(spark, str(tmp_path), "retention")["total"] == 0 and reports.run_report(spark, str(tmp_path), "progression")["characters"] == 0
    (tmp_path / "bad.json").write_text("{")
    assert reports.run_report(spark, str(tmp_path), "schema-summary")[0]["entities"] == 0
    assert discovery.describe_dataset(spark, str(tmp_path)).files[0].count == 0
    with pytest.raises(ValueError):
        reports.run_report(spark, folder, "nothing")


def test_rendering():
    assert render.truncated({"a": "x" * 9, "b": {"c": {"d": [1]}}}, 5, 2) == {"a": "xxxxx...", "b": {"c": "{Object}"}}
    assert render.truncated([[1]], 5, 1) == ["[Array(1)]"]
    assert "a: 1" in render.report_text("r", {"x": {"a": 1}})


def test_all_levels_in_one_pass(entities, monkeypatch):
    """Nested rows are walked without a cached copy of each level."""
    rows = [{"a.b": 1, "a": {"b": "]}\"{[", "c": [[{"x": 1.5, "y": None}], []]}}, {"a": None}, 7, [{"x": 9, "deep": [{"x": 4}, {"x": [5]}]}], {"x": {"x": 3}}]
    data = entities(rows)
    monkeypatch.setattr(discovery, "kept", None)
    got = {(r["path"], r["kind"], r["n"]) for r in discovery.profile(data).collect()}
    want = {("", "object", 5), ("a.b", "number", 1), ("a.b", "string", 1), ("a", "null", 2), ("a.c", "array", 1), ("a.c[*]", "array", 2), ("a.c[*][*]", "object", 1), ("a.c[*][*].x", "number", 1), ("a.c[*][*].y", "null", 1)}
    want |= {("[*]", "object", 1), ("[*].x", "number", 1), ("[*].deep", "array", 1), ("[*].deep[*]", "object", 2), ("[*].deep[*].x", "array", 1), ("[*].deep[*].x[*]", "number", 1), ("x", "object", 1), ("x.x", "number", 1)}
    assert {g for g in got if g[0] not in ("a", "[*].deep[*].x")} == {w for w in want if w[0] not in ("a", "[*].deep[*].x")}
    assert {r["path"] for r in discovery.profile(data, max_depth=1).collect()} == {"", "a.b", "a", "[*]", "x"}


def test_deep_max_without_levels_kept(entities, monkeypatch):
    rows = [{"p": {"x": 2, "y": [{"x": 5}, [{"x": 4}]]}}, {"p": {"y": [7], "x": [8]}}, {"q": 1}, {"p": None}]
    monkeypatch.setattr(reports, "kept", None)
    assert dict(reports.deep_max(entities(rows), "p", "x").collect()) == {0: 5.0, 1: None, 2: None, 3: None}


@pytest.mark.parametrize("work", [discovery.describe_dataset, reports.schema_summary])
def test_lost_executors_are_no_empty_files(spark, tmp_path, monkeypatch, work):
    write(tmp_path / "a.json", [{"x": 1}])

    def fail(*_):
        raise RuntimeError(message)

    monkeypatch.setattr("tessella.sources.json_files.read_entities", fail)
    message = "Job aborted due to stage failure: ExecutorLostFailure (executor 1 exited)"
    with pytest.raises(RuntimeError):
        work(spark, str(tmp_path))
    message = "[FAILED_READ_FILE.NO_HINT] Encountered error while reading file"
    found = work(spark, str(tmp_path))
    assert (found[0]["error"] if isinstance(found, list) else found.files[0].error) == message


def stored(spark, rows, path):
    """Rows as dynamic JSON in a Parquet file."""
    spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "pos long, j string").selectExpr("pos", "parse_json(j) as entity").write.parquet(path)
    return Dataset.variants(spark.read.parquet(path))


def test_rows_are_read_once(spark, tmp_path):
    """Neither a pass that counts levels first, nor one more for each count of a relationship."""
    left = stored(spark, [{"userId": f"u{i}", "otherId": f"u{i % 2}"} for i in range(10)], str(tmp_path / "l"))
    right = stored(spark, [{"memberIds": [f"u{i}", f"v{i}"], "id": f"u{i}"} for i in range(7)], str(tmp_path / "r"))
    spark.sparkContext.setJobGroup("once", "")
    try:
        related, seen = discovery.find_relationships(left, right), discovery.profile(left)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("once")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    scans = [f._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for f in (related, seen)]
    assert scans == [2, 1]
    got = [tuple(r) for r in related.select("left_path", "right_path", "matched", "left_count", "right_count", "kind").collect()]
    assert got == [("otherId", "id", 2, 2, 7, "many-to-one"), ("otherId", "memberIds[*]", 2, 2, 14, "many-to-one"), ("userId", "id", 7, 10, 7, "many-to-one"), ("userId", "memberIds[*]", 7, 10, 14, "many-to-one")]


@pytest.mark.parametrize("at_once", [1, 2, 3])
def test_levels_opened_by_several_expressions(entities, monkeypatch, at_once):
    rows = [{"a": {"b": [[{"c": {"id": 1}}], {"d": []}], "id": {"value": "x"}}}, 5, None, {"a": [None, {"a": {"a": {"id": "Ab:1"}}}]}]
    data = entities(rows)
    seen = lambda: (sorted(map(str, discovery.profile(data).collect())), sorted(map(str, discovery.id_values(data).collect())))
    want = seen()
    monkeypatch.setattr(discovery, "AT_ONCE", at_once)
    assert seen() == want and len(want[1]) == 3
