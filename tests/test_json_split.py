"""Large documents are cut into the elements that the parser sees in the whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.sources import json_files, json_split


def read(spark, path, root="entities"):
    return sorted((r[0], r[1]) for r in json_files.read_entities(spark, str(path), root).select("pos", F.to_json("entity")).collect())


def both(spark, path, monkeypatch, root="entities"):
    """(cut, whole) rows; cut only if the document is."""
    whole = read(spark, path, root)
    monkeypatch.setattr(json_split, "SPLIT_BYTES", 97)
    assert json_split.elements(spark, str(path), root) is not None
    return read(spark, path, root), whole


def value(rng, deep=0):
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "'", " ", "é", "x", "\n", ":", '"entities"']) for _ in range(rng.randrange(30)))
    simple = [text, rng.randrange(10**6), rng.random(), None, True, {}, []]
    if deep > 3 or rng.random() < 0.4:
        return rng.choice(simple)
    inner = [value(rng, deep + 1) for _ in range(rng.randrange(5))]
    return inner if rng.random() < 0.5 else {f"k,{i}]": x for i, x in enumerate(inner)}


@pytest.mark.parametrize("seed,indent", [(1, None), (2, 2), (3, None)])
def test_cut_equals_whole(spark, tmp_path, monkeypatch, seed, indent):
    rng = random.Random(seed)
    rows = [value(rng) for _ in range(120)] + ["long," * 300, None]
    document = {"a": [1, [2]], "meta": {"entities": [5]}, "entities": rows, "more": [value(rng) for _ in range(9)]}
    (tmp_path / "a.json").write_text(json.dumps(document, indent=indent, ensure_ascii=seed == 1))
    cut, whole = both(spark, tmp_path / "a.json", monkeypatch) if '"entities":' not in json.dumps(document["more"]) else (None, None)
    assert cut == whole and len(cut) == len(rows) and [pos for pos, _ in cut] == list(range(len(rows)))


def test_scalars_empty_and_other_roots(spark, tmp_path, monkeypatch):
    (tmp_path / "n.json").write_text('{"r\\u006fws" : [' + ", ".join(map(str, range(500))) + "]}")
    (tmp_path / "e.json").write_text('{"entities": [ \n ], "x": [' + "1," * 100 + "1]}")
    cut, whole = both(spark, tmp_path / "n.json", monkeypatch, "rows")
    assert cut == whole and len(cut) == 500
    assert read(spark, tmp_path / "e.json") == []


@pytest.mark.parametrize("text", ['{"entities": [1, 2], "x": [{"entities": [%s]}]}', "{'entities': [%s]}", '{"x": [%s], "entities": [1, 2]}', '[{"entities": [%s]}]'])
def test_left_to_the_parser(spark, tmp_path, monkeypatch, text):
    (tmp_path / "o.json").write_text(text % ("1, " * 200 + "1"))
    whole = read(spark, tmp_path / "o.json")
    monkeypatch.setattr(json_split, "SPLIT_BYTES", 97)
    assert json_split.elements(spark, str(tmp_path / "o.json"), "entities") is None
    assert whole and read(spark, tmp_path / "o.json") == whole


@pytest.mark.parametrize("text", ['{"entities": [%s, {"a": ]}', '{"entities": [%s,]}', '{"entities": [%s, {]}]}', '{"entities": [%s', '{"entities": [%s 1 2]}'])
def test_broken(spark, tmp_path, monkeypatch, text):
    (tmp_path / "b.json").write_text(text % ", ".join(["{}"] * 200))
    monkeypatch.setattr(json_split, "SPLIT_BYTES", 97)
    with pytest.raises(Exception):
        read(spark, tmp_path / "b.json")


def test_utf16(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_split, "SPLIT_BYTES", 97)
    (tmp_path / "u.json").write_text(json.dumps({"entities": list(range(300))}), encoding="utf-16")
    assert len(read(spark, tmp_path / "u.json")) == 300
