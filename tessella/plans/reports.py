"""Product reports over a directory with live.json (players) and chars.json (characters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.functions import paths
from tessella.functions.aggregates import DAY_MS
from tessella.functions.keeping import kept, letting_go
from tessella.functions.rounding import rounded
from tessella.operators.dataset import Dataset
from tessella.plans import discovery
from tessella.sources import json_files

#: Files, entity types and fields that the reports read.
PLAYERS_FILE, CHARACTERS_FILE = "live.json", "chars.json"
PLAYER, CHARACTER = "Player", "PlayerCharacter"
LOGIN_PATHS = ("payload.deviceHistory[*].firstLogin", "payload.deviceHistory[*].lastLogin", "payload.loginHistory[*].timestamp")
MORE_LOGIN_PATHS = ("payload.deviceHistory[*].firstSeenAt", "payload.deviceHistory[*].lastLoginAt")
EQUIPMENT_PATHS = ("payload.equippedItems[*]", "payload.equipment[*]", "payload.gear[*]")
CLASS_PATH, LEVEL_PATH, PLAYER_ID_PATH = "payload.character.characterClassId", "payload.level", "payload.playerId"
DAYS = (1, 3, 7)
#: More levels than the parser takes.
DEEPEST = 1000


def entities(spark: SparkSession, directory: str, name: str, kind: str) -> Dataset | None:
    """Entities of a type in a file of the directory; None if the file is missing."""
    found = [f for f in json_files.find_json_files(spark, directory) if f.name == name]
    if not found:
        return None
    data = Dataset.variants(json_files.read_entities(spark, found[0].path))
    return Dataset(data.df.filter(data.is_type(kind)), data.backend, data.order)


def _first_text(data: Dataset, path: str) -> Column:
    v = data.values(path)
    return paths.as_text(v.first(), v.dtype)


def span_days(data: Dataset, login_paths: tuple[str, ...]) -> Column:
    """Days between the first and last login of a row; NULL without logins. A time of 0 is none."""
    times = F.concat(*[F.transform(data.values(p).array(), lambda v: F.nullif(paths.as_millis(v, paths.VARIANT), F.lit(0.0))) for p in login_paths])
    times = F.filter(times, lambda x: x.isNotNull())
    return (F.array_max(times) - F.array_min(times)) / DAY_MS


def _retention(rows: DataFrame, keys: list[str]) -> DataFrame:
    span = F.coalesce("span", F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(span < 1).alias("new"), F.count_if(span >= 1).alias("returning"), *[F.count_if(span >= n).alias(f"d{n}") for n in DAYS]
    )


def _rates(r: dict) -> dict:
    out = {k: r[k] for k in ("total", "new", "returning")}
    for n in DAYS:
        out[f"d{n}"] = {"count": r[f"d{n}"], "rate": rounded(100 * r[f"d{n}"] / r["total"], 1) if r["total"] else 0.0}
    return out


def player_kpis(spark: SparkSession, directory: str) -> dict:
    """Players with the size of their rosters, characters with their classes."""
    out: dict = {"players": {"count": 0, "charactersPerPlayer": {"min": 0, "max": 0, "avg": 0.0}}, "characters": {"count": 0, "classes": {}}}
    if players := entities(spark, directory, PLAYERS_FILE, PLAYER):
        roster = F.size(players.values("payload.characterRoster.characterIds[*]").array())
        r = players.df.agg(F.count("*").alias("n"), F.min(roster).alias("least"), F.max(roster).alias("most"), F.avg(roster).alias("mean")).first()
        if r["n"]:
            out["players"] = {"count": r["n"], "charactersPerPlayer": {"min": r["least"], "max": r["most"], "avg": rounded(r["mean"], 2)}}
    if chars := entities(spark, directory, CHARACTERS_FILE, CHARACTER):
        rows = chars.df.select(_first_text(chars, CLASS_PATH).alias("class")).groupBy("class").count().collect()  # a row per class
        out["characters"] = {"count": sum(r["count"] for r in rows), "classes": {r["class"]: r["count"] for r in sorted(rows, key=lambda r: (-r["count"], r["class"] or "")) if r["class"]}}
    return out


def retention(spark: SparkSession, directory: str) -> dict:
    """New and returning players, and retention after 1, 3 and 7 days, over all players."""
    players = entities(spark, directory, PLAYERS_FILE, PLAYER)
    if not players:
        return _rates(dict.fromkeys(("total", "new", "returning", "d1", "d3", "d7"), 0))
    return _rates(_retention(players.df.select(span_days(players, LOGIN_PATHS).alias("span")), []).first().asDict())


def retention_by_class(spark: SparkSession, directory: str) -> dict[str, dict]:
    """Retention by character class; a player counts in each of their classes, one without a class in none."""
    players, chars = entities(spark, directory, PLAYERS_FILE, PLAYER), entities(spark, directory, CHARACTERS_FILE, CHARACTER)
    if not players or not chars:
        return {}
    classes = chars.df.select(_first_text(chars, PLAYER_ID_PATH).alias("player"), _first_text(chars, CLASS_PATH).alias("class")).na.drop().distinct()
    spans = players.df.select(_first_text(players, "entityId").alias("player"), span_days(players, LOGIN_PATHS + MORE_LOGIN_PATHS).alias("span"))
    rows = _retention(spans.join(classes, "player"), ["class"]).orderBy("class").collect()  # a row per class
    return {r["class"]: _rates(r.asDict()) for r in rows}


def progression(spark: SparkSession, directory: str) -> dict:
    """Levels and equipment of characters."""
    out: dict = {"maxLevel": 0, "avgLevel": 0.0, "atMaxLevel": 0, "levels": {}, "equipped": {"avg": 0.0, "total": 0}, "characters": 0}
    chars = entities(spark, directory, CHARACTERS_FILE, CHARACTER)
    if not chars:
        return out
    level = paths.as_number(chars.values(LEVEL_PATH).first(), paths.VARIANT)
    worn = sum((F.size(chars.values(p).array()) for p in EQUIPMENT_PATHS), F.lit(0))
    rows = chars.df.select(level.alias("level"), worn.alias("worn")).groupBy("level").agg(F.count("*").alias("n"), F.sum("worn").alias("worn")).collect()  # a row per level
    known = sorted((r["level"], r["n"]) for r in rows if r["level"] is not None)
    n, worn_total = sum(r["n"] for r in rows), sum(r["worn"] for r in rows)
    if known:
        shown = lambda x: int(x) if x == int(x) else x
        out |= {"maxLevel": shown(known[-1][0]), "atMaxLevel": known[-1][1], "levels": {shown(x): c for x, c in known}}
        out["avgLevel"] = rounded(sum(x * c for x, c in known) / sum(c for _, c in known), 2)
    return out | {"characters": n, "equipped": {"avg": rounded(worn_total / n, 2) if n else 0.0, "total": worn_total}}


def schema_summary(spark: SparkSession, directory: str) -> list[dict]:
    """Each file with its size, number of entities and schema."""
    from tessella.plans.render import schema_yaml

    out = []
    for f in json_files.find_json_files(spark, directory):
        row: dict = {"file": f.name, "sizeMb": rounded(f.megabytes, 2), "entities": 0, "schema": "", "error": None}
        try:
            with letting_go():
                data = Dataset.variants(kept(json_files.read_entities(spark, f.path)))
                row["entities"] = data.count().first()["total"]
                row["schema"] = schema_yaml(discovery.infer_schema(data, max_depth=3, max_examples=2))
        except Exception as e:  # an unreadable file is part of the summary
            row["error"] = json_files.blame_file(e)
        out.append(row)
    return out


def deep_max(data: Dataset, below: str, name: str) -> DataFrame:
    """(pos, most): the greatest number in a field of that name anywhere below a path, NULL if there is none."""
    start = data.df.select("pos", F.get(data.values(below).array(), F.lit(0)).alias("v"))
    x = F.when((F.col("name") == name) & ~F.col("item"), paths.as_number(F.col("v"), paths.VARIANT))
    return discovery.nodes(start, "v", DEEPEST, ("pos",)).groupBy("pos").agg(F.max(x).alias("most"))


def average_level(spark: SparkSession, directory: str, name: str = "itemLevel") -> dict:
    """Greatest item level of each character: mean over all characters, and a histogram."""
    chars = entities(spark, directory, CHARACTERS_FILE, CHARACTER)
    if not chars:
        return {"characters": 0, "average": 0.0, "levels": {}}
    with letting_go():
        rows = deep_max(chars, "payload", name).groupBy(F.coalesce("most", F.lit(0.0)).alias("level")).count().collect()
    n = sum(r["count"] for r in rows)
    return {"characters": n, "average": sum(r["level"] * r["count"] for r in rows) / n if n else 0.0, "levels": {r["level"]: r["count"] for r in sorted(rows, key=lambda r: r["level"])}}


REPORTS = {"player-kpis": player_kpis, "retention": retention, "retention-by-class": retention_by_class, "progression": progression, "schema-summary": schema_summary}


def run_report(spark: SparkSession, directory: str, name: str):
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}; one of {', '.join(REPORTS)}")
    return REPORTS[name](spark, directory)
