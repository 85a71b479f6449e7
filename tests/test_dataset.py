import pytest
from pyspark.sql import functions as F

from tessella.functions.aggregates import AggregateError, parse_aggregates
from tessella.functions.rounding import fixed, rounded
from tessella.operators.dataset import Dataset
from tessella.operators.joins import JoinError


def test_query_limit_counts(entities):
    data = entities([{"id": i, "v": {"w": [1, 2]}} for i in range(20)])
    found = data.query(["id", "v.w", "v.w.length"], "id >= 5", limit=3, offset=2)
    assert [r["id"].toPython() for r in found.rows.collect()] == [7, 8, 9]
    assert (found.total_matched, found.total_scanned) == (15, 20)
    assert found.rows.columns == ["id", "w", "length"]


def test_group_by_keys(entities):
    data = entities([{"k": 1}, {"k": "1"}, {"k": 1.0}, {"k": None}, {}, {"k": [1, "a"]}, {"k": True}, {"k": 1.5}])
    got = {r["key"]: r["count"] for r in data.group_by("k").collect()}
    assert got == {"1": 3, "null": 1, '[1,"a"]': 1, "true": 1, "1.5": 1}
    assert tuple(data.group_summary("k").first()) == (7, 5, 8)
    assert [r["key"] for r in data.group_by("k", sort="count").limit(1).collect()] == ["1"]


def test_stats_empty_is_zero(entities):
    assert tuple(entities([{"x": "a"}, {}]).stats("x").first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert tuple(entities([{"x": [1, 3, "a"]}, {"x": [5]}]).stats("x[*]").first()) == (3, 9.0, 3.0, 1.0, 5.0)


def test_distribution(entities):
    rows = entities([{"x": x} for x in (0, 1, 9, 10)]).distribution("x", 5).orderBy("bucket").collect()
    assert [r["count"] for r in rows] == [2, 0, 0, 0, 2] and rows[0]["label"] == "0.0-2.0" and rows[4]["percentage"] == 50.0
    assert entities([{"x": "a"}]).distribution("x").count() == 0
    assert [r["count"] for r in entities([{"x": 3}]).distribution("x", 2).orderBy("bucket").collect()] == [1, 0]


def test_sample(entities):
    data = entities([{"entityId": f"{'Player' if i % 2 else 'Npc'}:{i:x}", "i": i} for i in range(40)])
    one, two = ([r[0].toPython() for r in data.sample(5, entity_type="Player", seed=s).collect()] for s in (1, 1))
    assert one == two and len(one) == 5 and all(r["i"] % 2 for r in one)
    assert [str(r) for r in data.sample(5, seed=2).collect()] != [str(r) for r in data.sample(5, seed=3).collect()]
    assert data.sample(100).count() == 40


def test_type_filter_falls_back(entities):
    data = entities([{"entityId": "A:1"}, {"$type": "x.A, y"}, {"entityId": 7, "$type": "B"}, {}])
    assert data.df.filter(data.is_type("A")).count() == 2


def players_and_chars(entities):
    players = entities([{"entityId": f"Player:{i}", "tags": ["a", "b"] if i else [], "v": i, "flags": [True, 1, 0, "x"], "logins": [{"date": "2024-01-01"}, {"timestamp": "2024-01-09"}] if i == 1 else ["2024-01-01"]} for i in range(4)], "p.json")
    chars = entities([{"owner": f"Player:{i % 3}", "level": i, "cls": "x" if i % 2 else None} for i in range(6)] + [{"owner": None}, {}], "c.json")
    return players, chars


def test_join(entities):
    players, chars = players_and_chars(entities)
    found = chars.join(players, left_key="owner", right_key="entityId", select=["level", "b.v", "b.tags.length", "a.level.length"], filter="b.v > 0")
    rows = found.rows.collect()
    assert found.total_matched() == 4 and found.rows.columns == ["level", "v", "length", "length_a"]
    assert {r["length"] for r in rows} == {2} and {r["length_a"] for r in rows} == {0}
    either = chars.join(players, left_key="owner", right_key="entityId", filter="v = 1").total_matched()
    assert either == 2


def test_join_explodes_left_keys(entities):
    left = entities([{"ids": [1, "1", 2, None]}], "l.json")
    right = entities([{"id": "1"}, {"id": [2, 3]}, {"id": 2}], "r.json")
    assert left.join(right, left_key="ids[*]", right_key="id").total_matched() == 3
    assert left.join(entities([{"id": [7, 2]}], "s.json"), left_key="ids[*]", right_key="id[*]").total_matched() == 0
    assert left.join(entities([{"id": [7, 2]}], "s.json"), left_key="ids[*]", right_key="id[*]", explode_right=True).total_matched() == 1


def test_detected_keys(entities):
    players, chars = players_and_chars(entities)
    with pytest.raises(JoinError):
        entities([{"x": 1}], "x.json").join(players)
    owners = entities([{"ownerId": f"Player:{i}"} for i in range(3)], "o.json")
    found = owners.join(players)
    assert (found.left_key, found.right_key, found.total_matched()) == ("ownerId", "entityId", 3)


def test_aggregate_join(entities):
    players, chars = players_and_chars(entities)
    groups, totals = chars.aggregate_join(players, group_by="a.cls", left_key="owner", right_key="entityId", aggregate={"n": "COUNT(*)", "c": "count(a.cls)", "s": "SUM(a.level)", "m": "AVG(a.level)", "lo": "MIN(a.level)", "f": "COUNT_IF(b.flags[*])", "d": "D7_RETENTION(b.logins)", "bad": "D7_RETENTION(b.logins[*])"})
    got = {r["key"]: r.asDict() for r in groups.collect()}
    assert got["x"] | {"key": 0} == {"key": 0, "n": 3, "c": 3, "s": 9.0, "m": 3.0, "lo": 1.0, "f": 6, "d": 1, "bad": 0}
    assert got["null"]["c"] == 0 and got["null"]["n"] == 3
    t = totals.first()
    assert (t["n"], t["s"], t["m"], t["lo"]) == (6, 15.0, 2.5, 0.0)


def test_parse_aggregates():
    assert [a.function for a in parse_aggregates({"a": "sum(x.y)", "b": "D30_RETENTION(z)"})] == ["SUM", "RETENTION"]
    with pytest.raises(AggregateError):
        parse_aggregates({"a": "median(x)"})
    assert len(parse_aggregates({"a": "median(x)", "b": "COUNT(*)"}, strict=False)) == 1


def test_broken_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Dataset.json(spark, str(tmp_path / "none.json"))
    (tmp_path / "a.json").write_text('{"other": []}')
    assert Dataset.json(spark, str(tmp_path / "a.json")).df.count() == 0
    (tmp_path / "b.json").write_text('{"entities": {"x": 1}}')
    with pytest.raises(Exception):
        Dataset.json(spark, str(tmp_path / "b.json")).df.count()


def test_fixed():
    assert (fixed(0.25, 1), fixed(0.35, 1), rounded(2.675, 2)) == ("0.3", "0.3", 2.67)


def test_typed_maps(spark):
    df = spark.sql("select map('a', 1, 'b', 2) m, array(struct(1 as x), struct(null as x), null) l union all select null, null")
    data = Dataset.table(df)
    assert data.count("m[*] = 2").first()["total"] == 1
    assert data.count("m.a = 1").first()["total"] == 1
    assert {r["key"]: r["count"] for r in data.group_by("l[*].x").collect()} == {"1": 1, "null": 1}
    assert data.df.select(F.size(data.values("nothing.here").array())).first()[0] == 0
