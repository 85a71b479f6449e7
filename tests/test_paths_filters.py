import json
import random

import pytest
from pyspark.sql import functions as F
from tests import model

from tessella.functions import filters, paths
from tessella.operators.dataset import Dataset

ROWS = [
    {"id": 1, "a": {"b": {"c": 5}}, "list": [1, 2, 3], "items": [{"k": 1}, {"k": "1"}, {"k": None}, {}], "map": {"x": 1, "y": 2}, "t": "2024-01-02", "f": 1.7, "ok": True},
    {"id": 2, "a": {"b": None}, "list": [], "items": [], "map": {}, "t": "Level 5", "f": 1.5, "ok": False},
    {"id": 3, "a": None, "list": ["x", "1"], "items": {"z": {"k": 9}}, "t": "2024-03-01T10:00:00Z", "f": 1704153600000},
    {"id": 4, "n": None, "t": None, "list": [[1], [2]], "f": "1.6", "a": {"b": {"c": "5"}}},
    {"id": 5},
]


def test_parse_path():
    kinds = lambda p: [(s.kind, s.value) for s in paths.parse_path(p)]
    assert kinds("a.b[*].c[2]") == [("key", "a"), ("key", "b"), ("all", ""), ("key", "c"), ("index", "2")]
    assert kinds("[abc].*") == [("key", "abc"), ("key", "*")]
    assert paths.last_segment("a.items[0]") == "items[0]"


@pytest.mark.parametrize("text,expected", [
    ("a.b >= 5", ("a.b", ">=", 5.0)), ("a != \"x\"", ("a", "!=", "x")), ("a = null", ("a", "=", None)), ("a = true", ("a", "=", True)), ("a == 5", ("a", "=", "= 5")),
    ("a CONTAINS foo bar", ("a", "contains", "foo bar")), ("a startswith X", ("a", "startsWith", "X")), ("a.b exists", ("a.b", "exists", None)), ("a = 0x10", ("a", "=", 16.0)),
    ('name contains "a=b"', ("name", "contains", "a=b")), ("a < 1e3", ("a", "<", 1000.0)), ("a = 'q'", ("a", "=", "'q'")),
])
def test_parse_filter(text, expected):
    c = filters.parse_filter(text)
    assert (c.path, c.operator, c.value) == expected


def test_parse_filter_fails():
    for bad in ("", "a", "= 5", "a >"):
        with pytest.raises(filters.FilterError):
            filters.parse_filter(bad)


PATHS = ["a.b.c", "list[*]", "items[*].k", "map[*]", "list.length", "list[1]", "items.0.k", "a.b", "n", "missing", "t", "f", "ok", "list.1", "items.z.k"]


@pytest.mark.parametrize("path", PATHS)
def test_variant_values(entities, path):
    data = entities(ROWS)
    v = data.values(path)
    got = {r["id"]: json.loads(r["j"]) for r in data.df.select(F.try_variant_get("entity", "$.id", "int").alias("id"), F.to_json(F.transform(v.array(), lambda x: F.coalesce(F.to_json(x), F.lit("null")))).alias("j")).collect()}
    for row in ROWS:
        want = model.values(row, path)
        assert sorted(map(str, (json.loads(x) for x in got[row["id"]]))) == sorted(map(str, want)), row


FILTERS = [("a.b.c", "=", 5), ("a.b.c", "=", "5"), ("a.b.c", "!=", 5), ("n", "=", None), ("n", "!=", None), ("missing", "!=", 5), ("list", "contains", 1), ("list", "contains", "x"), ("t", "contains", "vel"),
           ("t", ">", "2024-01-03"), ("t", "<=", "2024-01-02"), ("f", ">", 1.5), ("f", ">=", "2024-01-02"), ("items[*].k", "=", 1), ("items[*].k", "exists", None), ("map[*]", ">", 1), ("t", "startsWith", "2024"), ("ok", "=", True), ("list[*]", "=", "1")]


@pytest.mark.parametrize("path,op,value", FILTERS)
def test_variant_filters(entities, path, op, value):
    data = entities(ROWS)
    rows = data.where(filters.Condition(path, op, float(value) if model.is_number(value) else value)).df
    got = {r[0] for r in rows.select(F.try_variant_get("entity", "$.id", "int")).collect()}
    assert got == {r["id"] for r in ROWS if model.holds(r, path, op, value)}


def test_typed_and_variant_agree(spark, entities):
    rng = random.Random(3)
    rows = [
        {"id": i, "s": rng.choice(["ab", "b", "2024-01-05", "c"]), "x": rng.choice([1.5, 2.0, 40.0]), "o": {"p": [{"q": rng.randint(0, 3), "w": rng.choice(["u", "v"])} for _ in range(rng.randint(0, 3))]}}
        for i in range(60)
    ]
    variant = entities(rows)
    schema = "id int, s string, x double, o struct<p: array<struct<q:int,w:string>>>"
    typed = Dataset.table(spark.createDataFrame([(r["id"], r["s"], r["x"], r["o"]) for r in rows], schema))
    for text in ("x > 1.5", "x = 2", "s != b", "s > 2024-01-01", "o.p[*].q = 2", "o.p[*].w contains u", "o.p[0].q >= 1", "o.p.length > 1", "s startsWith a", "x exists", "o.p[*].q != 1"):
        a = typed.count(text).first()
        b = variant.count(text).first()
        assert (a["total"], a["scanned"]) == (b["total"], b["scanned"]), text
    for path in ("s", "x", "o.p[*].q", "o.p[*].w", "o.p[1].q"):
        a, b = ({r["key"]: r["count"] for r in d.group_by(path).collect()} for d in (typed, variant))
        if path.startswith("o.p[1]"):
            a.pop("null", None)  # a typed row has NULL where a dynamic one has nothing
        assert a == b, path
    for path in ("x", "o.p[*].q", "s"):
        assert typed.stats(path).first() == variant.stats(path).first()


def test_big_integers_and_nulls(spark, entities):
    """Integers beyond 2^53, decimals and nulls mean the same in typed and dynamic rows."""
    values = [9007199254740992, 9007199254740993, 9007199254740994, -9007199254740993, 1234567890123456, 0, None]
    variant, typed = entities([{"x": v} for v in values]), Dataset.table(spark.createDataFrame([(v,) for v in values], "x long"))
    assert typed.df.filter(typed.predicate("x = 9007199254740993")).collect()[0][0] == 9007199254740993
    for text, n in (("x = 9007199254740993", 1), ("x > 9007199254740992", 2), ("x <= 9007199254740992", 4), ("x != 9007199254740993", 6), ("x != 5", 7), ("x = 1e400", 0), ("x < 99999999999999999999", 6), ("x = 0.5", 0), ("x >= 0x10", 4)):
        assert typed.count(text).first()["total"] == variant.count(text).first()["total"] == n, text
    want = {str(v) if v is not None else "null" for v in values}
    assert {r["key"] for r in typed.group_by("x").collect()} == {r["key"] for r in variant.group_by("x").collect()} == want
    money = Dataset.table(spark.sql("select cast(x as decimal(20,2)) x from values (1.50), (2.00), (12345678901234567.25) t(x)"))
    assert {r["key"] for r in money.group_by("x").collect()} == {"1.5", "2", "12345678901234567.25"} and money.count("x >= 2").first()["total"] == 2 and money.count("x = 1.5").first()["total"] == 1
    doubles = Dataset.table(spark.createDataFrame([(x,) for x in (1e15, 1.234567890123456e15, 1e20, 12345678.5, 0.0005, 1.5e-7, -0.0)], "x double"))
    assert {r["key"] for r in doubles.group_by("x").collect()} == {"1000000000000000", "1234567890123456", "100000000000000000000", "12345678.5", "0.0005", "1.5E-7", "0"}


def test_sampler_wildcards_are_for_arrays(spark, entities):
    rows = [{"m": {"a": 1}, "l": [{"b": 1}]}]
    assert [r[0] for r in entities(rows).sample(1, path="m[*]").collect()] == ["[]"] and [r[0] for r in entities(rows).sample(1, path="l[*].b").collect()] == ["1"]
    typed = Dataset.table(spark.sql("select map('a', 1) m, named_struct('c', 1) s, array(1, 2) l"))
    assert typed.sample(1, path="m[*]").first()[0] == typed.sample(1, path="s[*]").first()[0] == "[]" and typed.sample(1, path="l[*]").first()[0] == "[1,2]"


def test_value_documents(spark, tmp_path):
    from tessella.sources.json_files import read_values

    for text, want in (("[1, {\"a\": 2}]\n", ["1", '{"a":2}']), ('{"a": [1]}', ['{"a":[1]}']), (" [] ", [])):
        (tmp_path / "v.json").write_text(text)
        assert [r[0] for r in read_values(spark, str(tmp_path / "v.json")).select(F.to_json("entity")).collect()] == want


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "struct(id * 2 as b, 'x' as c) a", "'z' as unused").write.parquet(str(tmp_path / "t"))
    data = Dataset.table(spark.read.parquet(str(tmp_path / "t")))
    plan = data.query(["id"], ["id > 5", "a.b < 50"], limit=None).rows._jdf.queryExecution().toString()
    assert "GreaterThan(id,5)" in plan and "LessThan(a.b,50)" in plan and "unused" not in plan.split("ReadSchema")[-1]
