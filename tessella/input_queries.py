"""Queries over entity files and a source tree made from the driver's tables (`fixtures`), with the SQL over those tables that says the same."""

from __future__ import annotations

import io
import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella import fixtures
from tessella.functions import filters, paths
from tessella.operators.dataset import Dataset
from tessella.plans import discovery, render, reports
from tessella.queries import data, query, table
from tessella.sources import json_files
from tessella.symbols import graph, ranking, search, store


def _game(spark: SparkSession, d: str, name: str) -> Dataset:
    return Dataset.json(spark, f"{fixtures.game_files(spark, d)}/{name}.json")


def _text(data_: Dataset, path: str) -> F.Column:
    v = data_.values(path)
    return paths.as_text(v.first(), v.dtype)


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _plainly(found: DataFrame, **kinds: str) -> DataFrame:
    """Variant columns as the given types."""
    return found.select(*[F.try_variant_get(c, "$", t).alias(c) for c, t in kinds.items()])


_KEPT = "FROM orders WHERE o_orderkey % 3 = 0"
_SPANS = f"""WITH logins AS (SELECT o_custkey, o_orderdate AS t {_KEPT}),
spans AS (SELECT c_custkey, coalesce(date_diff('day', min(t), max(t)), 0) AS days FROM customer LEFT JOIN logins ON o_custkey = c_custkey GROUP BY 1)"""
_RETAINED = "count(*) AS total, count(*) FILTER (WHERE days < 1) AS new, count(*) FILTER (WHERE days >= 1) AS \"returning\", " + ", ".join(f"count(*) FILTER (WHERE days >= {n}) AS d{n}" for n in (1, 3, 7))


# JSON sources, paths and filters --------------------------------------------------------------------


@query("SELECT 'Player:' || c_custkey AS \"entityId\", c_name AS \"playerName\", c_acctbal AS balance FROM customer")
def q40_json_array_scan(spark, d):
    found = _game(spark, d, "live").query(["entityId", "payload.playerName", "payload.balance"], "payload.playerName exists", limit=None)
    return _plainly(found.rows, entityId="string", playerName="string", balance="double")


@query("SELECT CAST(r_regionkey AS BIGINT) + 1 AS pos, CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region UNION ALL SELECT 0, -1, NULL")
def q41_json_value_scan(spark, d):
    rows = json_files.read_values(spark, f"{fixtures.game_files(spark, d)}/list.json.txt")
    return rows.select("pos", F.try_variant_get("entity", "$.r_regionkey", "bigint").alias("key"), F.try_variant_get("entity", "$.r_name", "string").alias("name"))


@query("SELECT * FROM (VALUES ('chars.json', true), ('live.json', true)) AS t(name, readable)")
def q42_directory(spark, d):
    """The JSON files of a folder, each checked before it is opened."""
    found = json_files.find_json_files(spark, fixtures.game_files(spark, d))
    return _frame(spark, [(f.name, json_files.validate_file(spark, f.path) == f.path and f.size > 0) for f in found], "name string, readable boolean")


@query("SELECT 'Player' AS kind, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'Guild', 1 UNION ALL SELECT 'Play', 0")
def q43_entity_type(spark, d):
    live = _game(spark, d, "live")
    return live.df.agg(*[F.count_if(live.is_type(k)).alias(k) for k in ("Player", "Guild", "Play")]).unpivot([], ["Player", "Guild", "Play"], "kind", "n")


@query(
    f"""WITH t AS (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS place {_KEPT})
    SELECT 'Player:' || o_custkey AS "entityId", CAST(epoch_ms(o_orderdate) AS BIGINT) AS timestamp FROM t WHERE place = 2"""
)
def q44_index_path(spark, d):
    live = _game(spark, d, "live").where("payload.loginHistory[1].timestamp exists")
    second = live.values("payload.loginHistory[1].timestamp")
    return live.df.select(_text(live, "entityId").alias("entityId"), F.try_variant_get(second.first(), "$", "bigint").alias("timestamp"))


@query(f"SELECT 'Player:' || c_custkey AS \"entityId\" FROM customer WHERE c_custkey IN (SELECT o_custkey {_KEPT})")
def q45_exists(spark, d):
    found = _game(spark, d, "live").query(["entityId"], "payload.deviceHistory exists", limit=None)
    return _plainly(found.rows, entityId="string")


@query("SELECT c_mktsegment AS key, count(*) AS count FROM customer GROUP BY 1 ORDER BY count DESC, key LIMIT 3")
def q46_group_sorted(spark, d):
    """The three largest groups in display order; the limit is the feature."""
    return _game(spark, d, "live").group_by("payload.segment").limit(3)


@query("SELECT c_mktsegment AS key, count(*) AS count FROM customer GROUP BY 1 ORDER BY key LIMIT 2")
def q47_group_by_key(spark, d):
    """The first two groups by name; the limit is the feature."""
    return _game(spark, d, "live").group_by("payload.segment", sort="key").limit(2)


@query("SELECT CAST(n AS VARCHAR) AS key, count(*) AS count FROM (SELECT c_nationkey AS n FROM customer UNION ALL SELECT c_nationkey * 2 FROM customer) GROUP BY 1")
def q48_object_wildcard(spark, d):
    return _game(spark, d, "live").group_by("payload.marks[*]", sort=None)


_SAMPLED = f"""SELECT CASE WHEN count(*) = 0 THEN '[]' WHEN count(*) = 1 THEN CAST(any_value(t) AS VARCHAR) ELSE '[' || string_agg(t, ',' ORDER BY t) || ']' END AS value
FROM customer LEFT JOIN (SELECT o_custkey, epoch_ms(o_orderdate) AS t {_KEPT}) ON o_custkey = c_custkey GROUP BY c_custkey UNION ALL SELECT '[]'"""


@query(_SAMPLED.replace("count(*)", "count(t)"))
def q49_sample_path(spark, d):
    """A sample as large as the file; one value stands for itself, several are a list."""
    live = _game(spark, d, "live")
    return live.sample(live.df.count(), path="payload.loginHistory[*].timestamp")


@query("SELECT '[]' AS value, count(*) + 1 AS n FROM customer")
def q50_sample_arrays_only(spark, d):
    """In a sample's path a wildcard is no wildcard over the values of an object."""
    live = _game(spark, d, "live")
    return live.sample(live.df.count(), path="payload.marks[*]").groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('a > 5', true), ('a', false), ('= 5', false), ('a >', false), ('a exists', true), ('a ~ 5', false)) AS t(filter, valid)")
def q51_invalid_filters(spark, d):
    def valid(text: str) -> bool:
        try:
            return bool(filters.parse_filter(text))
        except filters.FilterError:
            return False

    return _frame(spark, [(t, valid(t)) for t in ("a > 5", "a", "= 5", "a >", "a exists", "a ~ 5")], "filter string, valid boolean")


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_orderkey") + F.lit(9007199254740000)).alias("id"), (F.col("o_custkey") + F.lit(9007199254740000)).alias("other"))


@query("SELECT o_orderkey + 9007199254740000 AS id, 'typed' AS side FROM orders WHERE o_orderkey = 993 UNION ALL SELECT o_orderkey + 9007199254740000, 'json' FROM orders WHERE o_orderkey > 990 AND o_orderkey <= 993")
def q38_big_int_filter(spark, d):
    """Integers beyond the exact range of doubles."""
    typed = Dataset.table(_wide(spark, d)).query(["id"], "id = 9007199254740993", limit=None).rows.select("id", F.lit("typed").alias("side"))
    rows = Dataset.json_text(_wide(spark, d).select(F.to_json(F.struct("id")).alias("j")), "j").where(["id > 9007199254740990", "id <= 9007199254740993"])
    return typed.union(rows.df.select(paths.exact_integer(rows.values("id").first(), paths.VARIANT), F.lit("json")))


@query("SELECT a.o_orderkey + 9007199254740000 AS id, count(*) AS n FROM orders a JOIN orders b ON a.o_orderkey = b.o_custkey GROUP BY 1")
def q39_big_int_join(spark, d):
    """A typed key meets the same number in dynamic rows."""
    right = Dataset.json_text(_wide(spark, d).select(F.to_json(F.struct("other")).alias("j")), "j")
    found = Dataset.table(_wide(spark, d)).join(right, left_key="id", right_key="other", select=["a.id"], limit=None)
    return found.rows.groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_custkey + 9007199254740000 AS VARCHAR) AS key, count(*) AS count FROM orders GROUP BY 1")
def q52_big_int_group(spark, d):
    return Dataset.json_text(_wide(spark, d).select(F.to_json(F.struct("other")).alias("j")), "j").group_by("other", sort=None)


@query("SELECT count(*) FILTER (WHERE o_orderkey % 7 <> 3) AS total, count(*) AS scanned, 'typed' AS side FROM orders UNION ALL SELECT count(*) FILTER (WHERE o_orderkey % 7 <> 3), count(*), 'json' FROM orders")
def q53_not_equal_null(spark, d):
    """An explicit null differs from a number, in typed and in dynamic rows."""
    rows = table(spark, d, "orders").select(F.nullif(F.col("o_orderkey") % 7, F.lit(5)).alias("x"))
    dynamic = Dataset.json_text(rows.select(F.to_json(F.struct("x"), {"ignoreNullFields": "false"}).alias("j")), "j")
    return Dataset.table(rows).count("x != 3").withColumn("side", F.lit("typed")).union(dynamic.count("x != 3").withColumn("side", F.lit("json")))


# Joins and discovery --------------------------------------------------------------------------------


@query("SELECT count(*) AS n, 'payload.playerId' AS left_key, 'entityId' AS right_key FROM orders JOIN customer ON o_custkey = c_custkey")
def q54_detected_keys(spark, d):
    found = _game(spark, d, "chars").join(_game(spark, d, "live"))
    return found.joined.agg(F.count("*").alias("n")).select("n", F.lit(found.left_key).alias("left_key"), F.lit(found.right_key).alias("right_key"))


@query("SELECT count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high, count(*) FILTER (WHERE c_acctbal > 5000) AS rich FROM orders JOIN customer ON o_custkey = c_custkey")
def q55_unprefixed_join_filter(spark, d):
    chars, live = _game(spark, d, "chars"), _game(spark, d, "live")
    joined = lambda test: chars.join(live, left_key="payload.playerId", right_key="entityId", filter=test).joined.agg(F.count("*"))
    high = joined('payload.character.characterClassId = "2-HIGH"').toDF("high")
    return high.crossJoin(F.broadcast(joined("payload.balance > 5000").toDF("rich")))  # a row each


@query(
    """WITH a AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), b AS (SELECT count(*) AS n FROM orders), c AS (SELECT count(*) AS n FROM customer)
    SELECT 1 AS place, 'payload.playerId' AS left_path, 'entityId' AS right_path, a.n AS matched, a.n AS left_count, c.n + 1 AS right_count, 'many-to-one' AS kind FROM a, c
    UNION ALL SELECT 2, 'entityId', 'payload.characterRoster.characterIds[*]', b.n, b.n + 1, b.n, 'many-to-one' FROM b"""
)
def q56_relationship_order(spark, d):
    """Relationships of two files, best coverage first."""
    rows = discovery.find_relationships(_game(spark, d, "chars"), _game(spark, d, "live")).collect()
    return _frame(spark, [(i, r["left_path"], r["right_path"], r["matched"], r["left_count"], r["right_count"], r["kind"]) for i, r in enumerate(rows, 1)], "place int, left_path string, right_path string, matched long, left_count long, right_count long, kind string")


@query(
    """SELECT 'entityId' AS path, count(*) + 1 AS n, 'EntityId:*' AS form FROM customer UNION ALL SELECT 'payload.characterRoster.characterIds[*]', count(*), 'PlayerCharacter:*' FROM orders"""
)
def q57_id_value_form(spark, d):
    return discovery.id_fields(_game(spark, d, "live"))


@query(
    """WITH t AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'Zone:x' || o_orderkey WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN o_orderpriority
      WHEN 3 THEN '0f0f0f0f-1234-1234-1234-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ELSE 'Ab1:' || o_orderkey END AS x FROM orders)
    SELECT CASE WHEN regexp_matches(x, '^[A-Za-z]+:[A-Za-z0-9]+$') THEN split_part(x, ':', 1) || ':xxx' WHEN regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'ISO date'
      WHEN regexp_matches(x, '^[0-9a-fA-F]{8}-') THEN 'GUID' END AS form, count(*) AS n FROM t GROUP BY 1"""
)
def q58_text_patterns(spark, d):
    key = F.col("o_orderkey").cast("string")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Zone:x"), key)).when(F.col("o_orderkey") % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 2, F.col("o_orderpriority"))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("0f0f0f0f-1234-1234-1234-"), F.lpad(key, 12, "0"))).otherwise(F.concat(F.lit("Ab1:"), key))
    )
    return table(spark, d, "orders").select(discovery.text_form(text).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('entityId', 'Guild:xxx'), ('payload.characterRoster.characterIds[*]', 'PlayerCharacter:xxx'), ('payload.deviceHistory[*].firstLogin', 'ISO date'), ('payload.deviceHistory[*].lastLogin', 'ISO date')) AS t(path, pattern)")
def q59_schema_patterns(spark, d):
    return discovery.profile(_game(spark, d, "live")).filter("pattern is not null").select("path", "pattern")


_ITEMS = """WITH i AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber <= 2) AS worn, count(*) FILTER (WHERE l_linenumber = 3) AS gear FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey, i.* FROM orders LEFT JOIN i ON l_orderkey = o_orderkey)"""


@query(
    f"""{_ITEMS}, n AS (SELECT count(*) AS n FROM orders)
    SELECT '' AS path, 'object' AS kind, n + 1 AS n, NULL AS least, NULL AS most FROM n UNION ALL SELECT 'entityId', 'string', n + 1, NULL, NULL FROM n
    UNION ALL SELECT unnest(['$type', 'payload.playerId', 'payload.character.characterClassId']), 'string', n, NULL, NULL FROM n UNION ALL SELECT unnest(['payload', 'payload.character']), 'object', n, NULL, NULL FROM n
    UNION ALL SELECT 'payload.level', 'number', count(*), NULL, NULL FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'payload.equipment', 'array', n, 0, 0 FROM n
    UNION ALL SELECT 'payload.equippedItems', 'array', count(worn), CAST(min(worn) AS INTEGER), CAST(max(worn) AS INTEGER) FROM c UNION ALL SELECT 'payload.gear', 'array', count(gear), CAST(min(gear) AS INTEGER), CAST(max(gear) AS INTEGER) FROM c
    UNION ALL SELECT 'payload.equippedItems[*]', 'object', sum(worn)::BIGINT, NULL, NULL FROM c UNION ALL SELECT unnest(['payload.equippedItems[*].itemLevel', 'payload.equippedItems[*].part']), 'number', sum(worn)::BIGINT, NULL, NULL FROM c
    UNION ALL SELECT 'payload.gear[*]', 'object', sum(gear)::BIGINT, NULL, NULL FROM c UNION ALL SELECT unnest(['payload.gear[*].itemLevel', 'payload.gear[*].part']), 'number', sum(gear)::BIGINT, NULL, NULL FROM c"""
)
def q60_schema_levels(spark, d):
    """The profile of nested rows with arrays."""
    return discovery.profile(_game(spark, d, "chars")).select("path", "kind", "n", "least", "most")


@query(
    f"""{_ITEMS} SELECT * FROM (VALUES ('entityId', false), ('$type', true), ('payload', true), ('payload.playerId', false), ('payload.character', false), ('payload.character.characterClassId', false), ('payload.level', true), ('payload.equipment', false)) AS t(path, optional)
    UNION ALL SELECT unnest(['payload.equippedItems', 'payload.gear']), count(*) > count(worn) FROM c
    UNION ALL SELECT unnest(['payload.equippedItems[*].itemLevel', 'payload.equippedItems[*].part', 'payload.gear[*].itemLevel', 'payload.gear[*].part']), false"""
)
def q61_schema_merge(spark, d):
    """Fields that some object at that place lacks."""
    node = discovery.infer_schema(_game(spark, d, "chars"))
    return _frame(spark, [(p, n.optional) for p, _, n in discovery.walk_nodes(node)], "path string, optional boolean")


@query("""SELECT 'r_regionkey: number (e.g. "' || min(r_regionkey) || '", "' || max(r_regionkey) || '")' AS line FROM region UNION ALL SELECT 'r_name: string (e.g. "' || min(r_name) || '", "' || max(r_name) || '")' FROM region""")
def q62_schema_text(spark, d):
    text = render.schema_yaml(discovery.infer_schema(data(spark, d, "region"), max_examples=2))
    return _frame(spark, [(line,) for line in text.splitlines()], "line string")


@query(
    """SELECT 'chars.json' AS file, count(*) + 1 AS count, 'PlayerCharacter' AS entity_type, 'entityId,payload.character.characterClassId,payload.playerId' AS keys FROM orders
    UNION ALL SELECT 'live.json', count(*) + 1, 'Player', 'entityId,payload.characterRoster.characterIds' FROM customer"""
)
def q63_dataset_description(spark, d):
    about = discovery.describe_dataset(spark, fixtures.game_files(spark, d))
    return _frame(spark, [(f.name, f.count, f.entity_type, ",".join(sorted(f.key_fields))) for f in about.files], "file string, count long, entity_type string, keys string")


@query(
    """SELECT * FROM (VALUES ('Group by entityId in chars.json'), ('Group by entityId in live.json'), ('Analyze payload.deviceHistory in live.json'),
    ('Join chars.json with live.json on payload.playerId = entityId'), ('Join chars.json with live.json on entityId = payload.characterRoster.characterIds[*]')) AS t(suggestion)"""
)
def q64_suggestions(spark, d):
    about = discovery.describe_dataset(spark, fixtures.game_files(spark, d))
    return _frame(spark, [(s,) for s in about.suggested_queries], "suggestion string")


# Reports --------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT 'players' AS name, CAST(count(*) AS DECIMAL(18,2)) AS value FROM r UNION ALL SELECT 'least', min(n) FROM r UNION ALL SELECT 'most', max(n) FROM r UNION ALL SELECT 'mean', CAST(avg(n) AS DECIMAL(18,2)) FROM r
    UNION ALL SELECT 'characters', count(*) FROM orders UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1"""
)
def q23_kpis(spark, d):
    out = reports.run_report(spark, fixtures.game_files(spark, d), "player-kpis")
    sizes = out["players"]["charactersPerPlayer"]
    rows = {"players": out["players"]["count"], "least": sizes["min"], "most": sizes["max"], "mean": sizes["avg"], "characters": out["characters"]["count"]} | out["characters"]["classes"]
    return _frame(spark, [(k, Decimal(str(v))) for k, v in rows.items()], "name string, value decimal(18,2)")


@query(
    f"""{_SPANS}, r AS (SELECT {_RETAINED} FROM spans)
    SELECT total, new, "returning", d1, CAST(100 * d1 / total AS DECIMAL(18,1)) AS rate1, d3, CAST(100 * d3 / total AS DECIMAL(18,1)) AS rate3, d7, CAST(100 * d7 / total AS DECIMAL(18,1)) AS rate7 FROM r"""
)
def q65_report_retention(spark, d):
    out = reports.run_report(spark, fixtures.game_files(spark, d), "retention")
    days = [x for n in (1, 3, 7) for x in (out[f"d{n}"]["count"], Decimal(str(out[f"d{n}"]["rate"])))]
    return _frame(spark, [(out["total"], out["new"], out["returning"], *days)], "total long, new long, returning long, d1 long, rate1 decimal(18,1), d3 long, rate3 decimal(18,1), d7 long, rate7 decimal(18,1)")


@query(f"{_SPANS}, c AS (SELECT DISTINCT o_custkey, o_orderpriority AS class FROM orders) SELECT class, {_RETAINED} FROM c JOIN spans ON o_custkey = c_custkey GROUP BY 1")
def q24_retention_by_class(spark, d):
    out = reports.run_report(spark, fixtures.game_files(spark, d), "retention-by-class")
    return _frame(spark, [(k, r["total"], r["new"], r["returning"], *[r[f"d{n}"]["count"] for n in (1, 3, 7)]) for k, r in out.items()], "class string, total long, new long, returning long, d1 long, d3 long, d7 long")


@query(
    f"""{_ITEMS}, l AS (SELECT o_orderkey % 40 AS level FROM orders WHERE o_orderkey % 7 <> 0), w AS (SELECT sum(coalesce(worn, 0) + coalesce(gear, 0)) AS total, count(*) AS n FROM c)
    SELECT CAST(max(level) AS BIGINT) AS most, CAST(avg(level) AS DECIMAL(18,2)) AS mean, count(*) FILTER (WHERE level = (SELECT max(level) FROM l)) AS at_most, (SELECT n FROM w) AS characters,
    (SELECT CAST(total AS BIGINT) FROM w) AS equipped, (SELECT CAST(total / n AS DECIMAL(18,2)) FROM w) AS equipped_mean FROM l"""
)
def q25_progression(spark, d):
    out = reports.run_report(spark, fixtures.game_files(spark, d), "progression")
    row = (out["maxLevel"], Decimal(str(out["avgLevel"])), out["atMaxLevel"], out["characters"], out["equipped"]["total"], Decimal(str(out["equipped"]["avg"])))
    return _frame(spark, [row], "most long, mean decimal(18,2), at_most long, characters long, equipped long, equipped_mean decimal(18,2)")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey % 40) AS INTEGER) AS place, o_orderkey % 40 AS level, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 2")
def q66_levels_in_order(spark, d):
    out = reports.run_report(spark, fixtures.game_files(spark, d), "progression")
    return _frame(spark, [(i, level, n) for i, (level, n) in enumerate(out["levels"].items(), 1)], "place int, level long, n long")


@query("SELECT 'chars.json' AS file, count(*) + 1 AS entities, true AS described FROM orders UNION ALL SELECT 'live.json', count(*) + 1, true FROM customer")
def q67_schema_summary(spark, d):
    out = reports.run_report(spark, fixtures.game_files(spark, d), "schema-summary")
    return _frame(spark, [(r["file"], r["entities"], r["error"] is None and "payload" in r["schema"]) for r in out], "file string, entities long, described boolean")


_MOST = "SELECT o_orderkey, max(l_quantity) FILTER (WHERE l_linenumber <= 3) AS most FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


@query(f"SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, most FROM ({_MOST})")
def q68_recursive_descent(spark, d):
    chars = _game(spark, d, "chars")
    return reports.deep_max(Dataset(chars.df.filter(chars.is_type("PlayerCharacter")), chars.backend, chars.order), "payload", "itemLevel")


@query(f"SELECT CAST(coalesce(most, 0) AS DOUBLE) AS level, count(*) AS n, (SELECT CAST(avg(coalesce(most, 0)) AS DECIMAL(18,6)) FROM ({_MOST})) AS average FROM ({_MOST}) GROUP BY 1")
def q69_average_level(spark, d):
    out = reports.average_level(spark, fixtures.game_files(spark, d))
    return _frame(spark, [(level, n, Decimal(f"{out['average']:.6f}")) for level, n in out["levels"].items()], "level double, n long, average decimal(18,6)")


# Symbols --------------------------------------------------------------------------------------------

_CORE = "(VALUES ('INation', 'interface', 3), ('Size', 'enum', 4), ('Spot', 'struct', 5)) AS t(name, kind, line)"
_SYMBOLS = f"""(SELECT 'R' || n_regionkey || '/N' || n_nationkey || '.cs' AS file, 'Nation' || n_nationkey AS name, 'class' AS kind, 'World.R' || n_regionkey AS namespace, 6 AS line FROM nation
UNION ALL SELECT 'Core/Regions.cs', name, kind, 'World.Core', line FROM {_CORE} UNION ALL SELECT 'Core/Regions.cs', 'Region' || r_regionkey, 'class', 'World.Core', 6 + r_regionkey FROM region
UNION ALL SELECT 'Globals.cs', 'Globals', 'class', NULL, 1)"""
_NEXT = "(n_nationkey + 1) % 25"
_FILE = "'R' || n_regionkey || '/N' || n_nationkey || '.cs'"


@query(f"SELECT file AS path FROM {_SYMBOLS} GROUP BY 1")
def q70_source_scan(spark, d):
    """Source files, without ignored folders, hidden files and what .gitignore names."""
    return store.scan_sources(spark, fixtures.sources(spark, d)).select(F.col("relativePath").alias("path"))


@query(f"SELECT file, name, kind, namespace, CAST(line AS INTEGER) AS line FROM {_SYMBOLS}")
def q71_extracted_symbols(spark, d):
    return fixtures.knowledge(spark, d).symbols.select(F.col("relativePath").alias("file"), "name", "kind", "namespace", "line")


@query("SELECT 'Nation' || n_nationkey AS name, 'Region' || n_regionkey || ',INation' AS bases, 'Serializable' AS attributes FROM nation")
def q72_bases_and_attributes(spark, d):
    rows = fixtures.knowledge(spark, d).symbols.filter("bases is not null")
    return rows.select("name", F.array_join("bases", ",").alias("bases"), F.array_join("attributes", ",").alias("attributes"))


@query(
    """SELECT 'Visit' || n_nationkey AS name, 'protected void Visit' || n_nationkey || '(Region' || n_regionkey || ' target, int times)' AS signature, NULL AS message FROM nation
    UNION ALL SELECT 'Awake', 'private void Awake()', true FROM nation WHERE n_nationkey % 2 = 0"""
)
def q73_methods(spark, d):
    """Methods that are public, protected or called by the engine; others are left out."""
    return fixtures.knowledge(spark, d).members.filter("kind = 'method'").select("name", "signature", F.col("isUnityMessage").alias("message"))


@query("SELECT 'Nation' || n_nationkey AS symbol, 'public string Title { get; set; }' AS signature FROM nation")
def q74_properties(spark, d):
    return fixtures.knowledge(spark, d).members.filter("kind = 'property'").select("symbol", "signature")


@query(f"SELECT 'Nation' || n_nationkey AS symbol, 'public Nation' || {_NEXT} || ' neighbour' AS signature FROM nation UNION ALL SELECT 'Region' || r_regionkey, 'public int size' FROM region UNION ALL SELECT 'Spot', 'public int x'")
def q75_fields(spark, d):
    return fixtures.knowledge(spark, d).members.filter("kind = 'field'").select("symbol", "signature")


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(['field', 'property', 'method']) AS kind FROM nation UNION ALL SELECT 'method' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'field' FROM region UNION ALL SELECT unnest(['field', 'enum_member', 'enum_member'])) GROUP BY 1")
def q76_member_kinds(spark, d):
    """Kinds of members; constructors, events and the like are none."""
    kind = F.when(F.col("symbolKind") == "enum", "enum_member").otherwise(F.col("kind"))
    return fixtures.knowledge(spark, d).members.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT {_FILE} AS file, unnest(['System', 'World', 'Core', 'R' || n_regionkey, 'Region' || n_regionkey, 'INation', 'Serializable', 'Nation' || {_NEXT}, 'Debug', 'Log', 'target']) AS type FROM nation
    UNION ALL SELECT 'Core/Regions.cs', unnest(['World', 'Core'])"""
)
def q77_used_names(spark, d):
    return fixtures.knowledge(spark, d).edges.select(F.col("relativePath").alias("file"), "type")


@query(f"SELECT {_FILE} AS file, 'Debug.Log' AS call FROM nation")
def q78_calls(spark, d):
    return fixtures.knowledge(spark, d).file_symbols.select(F.col("relativePath").alias("file"), F.explode("dependencies.calls").alias("call"))


_SOURCE = fixtures.NATION_SOURCE.replace("'", "''").replace("{{", "{").replace("}}", "}")
for _name, _value in (("{region}", "n_regionkey"), ("{key}", "n_nationkey"), ("{next}", f"({_NEXT})"), ("{message}", "CASE WHEN n_nationkey % 2 = 0 THEN 'Awake' ELSE 'Prepare' END")):
    _SOURCE = _SOURCE.replace(_name, f"' || {_value} || '")


@query(f"SELECT {_FILE} AS path, CAST(strlen(text) AS BIGINT) AS size, substr(sha256(text), 1, 16) AS hash, 1 AS symbols FROM (SELECT *, '{_SOURCE}' AS text FROM nation)")
def q79_manifest(spark, d):
    files = fixtures.knowledge(spark, d).files.filter("relativePath like 'R%'")
    return files.select(F.col("relativePath").alias("path"), "size", "hash", F.col("symbolCount").alias("symbols"))


@query(f"SELECT file, count(*) AS n, (SELECT count(*) + 2 FROM nation) AS files FROM {_SYMBOLS} GROUP BY 1")
def q80_json_layout(spark, d):
    """Written in the JSON layout and read again, as the manifest lists it."""
    kb, root = fixtures.knowledge(spark, d), f"{fixtures.knowledge_dir(spark, d)}/.exchange"
    kb.to_json(root)
    again = store.KnowledgeBase.from_json(spark, root)
    return again.symbols.groupBy(F.col("relativePath").alias("file")).agg(F.count("*").alias("n")).withColumn("files", F.lit(again.meta["fileCount"]).cast("long"))


@query("SELECT 'world' AS project, count(*) + 2 AS files, count(*) + 9 AS symbols FROM nation")
def q81_project_meta(spark, d):
    base = fixtures.knowledge_dir(spark, d)
    metas = [store.KnowledgeBase.open(spark, base, n).meta for n in store.list_projects(spark, base)]
    return _frame(spark, [(m["name"], m["fileCount"], m["symbolCount"]) for m in metas], "project string, files long, symbols long")


@query(f"SELECT coalesce(namespace, '_global') AS namespace, count(*) AS symbols, count(DISTINCT file) AS files FROM {_SYMBOLS} GROUP BY 1")
def q82_namespace_index(spark, d):
    rows = spark.read.parquet(f"{fixtures.knowledge_dir(spark, d)}/world/by-namespace")
    return rows.groupBy("namespace").agg(F.count("*").alias("symbols"), F.count_distinct("file").alias("files"))


_BY_TYPE = f"SELECT {_FILE} AS src, unnest(['Region' || n_regionkey, 'INation', 'Nation' || {_NEXT}]) AS dst FROM nation"


@query(f"SELECT src, dst, count(*) AS n FROM ({_BY_TYPE}) GROUP BY ALL")
def q83_symbol_edges(spark, d):
    """Names that files use and that are symbols."""
    kb = fixtures.knowledge(spark, d)
    found = kb.edges.join(kb.symbols.select(F.col("name").alias("type")).distinct(), "type")
    return found.groupBy(F.col("relativePath").alias("src"), F.col("type").alias("dst")).agg(F.count("*").alias("n"))


_OUT = """SELECT 'Nation' || n_nationkey AS name, CAST(n_nationkey AS INTEGER) AS depth FROM nation WHERE n_nationkey BETWEEN 1 AND 3
UNION ALL SELECT 'Region' || n_regionkey, CAST(min(n_nationkey) + 1 AS INTEGER) FROM nation WHERE n_nationkey < 3 GROUP BY n_regionkey UNION ALL SELECT 'INation', 1"""


@query(_OUT)
def q28_deps(spark, d):
    return graph.outgoing(fixtures.knowledge(spark, d), "nation0", 3).select("name", "depth")


@query("SELECT 'Nation' || n_nationkey AS name, CAST(10 - n_nationkey AS INTEGER) AS depth, 'World.R' || n_regionkey AS namespace FROM nation WHERE n_nationkey BETWEEN 6 AND 9")
def q84_incoming(spark, d):
    return graph.incoming(fixtures.knowledge(spark, d), "Nation10", 4).select("name", "depth", "namespace")


@query(f"SELECT 'incoming' AS side, 'Nation' || n_nationkey AS name FROM nation WHERE {_NEXT} = 7 UNION ALL SELECT 'outgoing', unnest(['Nation8', 'INation', 'Region' || n_regionkey]) FROM nation WHERE n_nationkey = 7")
def q85_dependencies(spark, d):
    found = graph.dependencies(fixtures.knowledge(spark, d), "NATION7")
    return _frame(spark, [(s, r["name"]) for s in ("incoming", "outgoing") for r in found[s]], "side string, name string")


@query(f"SELECT 'Nation' || n_nationkey AS symbol, {_FILE} AS file, 3 + CAST(n_nationkey % 2 = 0 AS INTEGER) AS \"memberCount\" FROM nation WHERE n_regionkey = 2")
def q86_implementations(spark, d):
    return search.implementations(fixtures.knowledge(spark, d), "Region2", limit=None).select("symbol", "file", "memberCount")


@query(
    f"""SELECT 'Nation' || n_nationkey AS symbol, 'name' AS match, 6 AS line FROM nation WHERE contains(lower('Nation' || n_nationkey), 'nation1')
    UNION ALL SELECT 'Nation' || n_nationkey || '.neighbour', 'signature', 9 FROM nation WHERE contains('nation' || {_NEXT}, 'nation1')"""
)
def q26_search(spark, d):
    return search.search(fixtures.knowledge(spark, d), "NATION1", limit=None).select("symbol", "match", "line")


@query(
    """SELECT 'Nation' || n_nationkey || '.Visit' || n_nationkey AS symbol, 'method' AS kind, 'member' AS match FROM nation WHERE n_regionkey = 3
    UNION ALL SELECT 'Nation' || n_nationkey || '.Visit' || n_nationkey, 'method', 'signature' FROM nation WHERE n_regionkey < 0"""
)
def q87_search_members(spark, d):
    return search.search(fixtures.knowledge(spark, d), "visit", kind="class", namespace="World.R3", limit=None).select("symbol", "kind", "match")


@query(f"SELECT 'Nation' || n_nationkey AS symbol FROM nation ORDER BY {_FILE} LIMIT 5")
def q88_search_limit(spark, d):
    """The first five matches in the files' order; the limit is the feature."""
    return search.search(fixtures.knowledge(spark, d), "nation", path="R", kind="class", limit=None).filter("match = 'name'").limit(5).select("symbol")


@query("SELECT 'Nation' || n_nationkey AS symbol, 'class' AS kind, 'World.R1' AS namespace, 4 AS \"memberCount\" FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0")
def q27_find(spark, d):
    found = search.find(fixtures.knowledge(spark, d), kind="class", namespace="World.R1", base="Region", has_attribute="Serial", has_member="awake", is_unity_message=True, limit=None)
    return found.select("symbol", "kind", "namespace", "memberCount")


@query(f"SELECT {_FILE} AS file, 'Nation' || n_nationkey AS name, 3 + CAST(n_nationkey % 2 = 0 AS INTEGER) AS members, 'Debug.Log' AS calls FROM nation WHERE n_regionkey = 4")
def q89_export(spark, d):
    rows = search.export(fixtures.knowledge(spark, d), "World.R4")
    return rows.select("file", "name", F.size("members").alias("members"), F.array_join("dependencies.calls", ",").alias("calls"))


@query(f"SELECT 'Nation' || n_nationkey AS name, {_FILE} AS file, 6 AS line FROM nation WHERE n_nationkey = 12")
def q90_get_symbol(spark, d):
    return search.get_symbol(fixtures.knowledge(spark, d), "Nation12", "World").select("name", "file", "line")


@query(
    f"""SELECT 'namespace' AS kind, 'World.R' || n_regionkey AS name FROM nation GROUP BY ALL UNION ALL SELECT 'symbol', 'Nation' || n_nationkey FROM nation WHERE n_regionkey = 0
    UNION ALL SELECT 'file', {_FILE} FROM nation WHERE n_nationkey = 3"""
)
def q91_lookups(spark, d):
    kb = fixtures.knowledge(spark, d)
    names = search.list_namespaces(kb, "World.R").select(F.lit("namespace").alias("kind"), F.col("namespace").alias("name"))
    inside = search.namespace_summary(kb, "World.R0").select(F.lit("symbol"), "name")
    (path,) = [r["relativePath"] for r in kb.files.filter("relativePath like '%/N3.cs'").collect()]
    return names.union(inside).union(search.file_symbols(kb, path).select(F.lit("file"), "relativePath"))


@query(f"SELECT coalesce(namespace, '(global)') AS namespace, count(*) AS count FROM {_SYMBOLS} GROUP BY 1")
def q36_namespace_stats(spark, d):
    return search.namespace_counts(fixtures.knowledge(spark, d))


@query(
    f"""WITH c AS (SELECT coalesce(namespace, '(global)') AS namespace, count(*) AS n FROM {_SYMBOLS} GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, namespace LIMIT 3)
    SELECT CAST(row_number() OVER (ORDER BY n DESC, namespace) AS INTEGER) AS place, namespace, n, (SELECT count(*) FROM c) AS namespaces, (SELECT count(*) + 2 FROM nation) AS files, (SELECT count(*) + 9 FROM nation) AS symbols FROM t"""
)
def q30_stats_top(spark, d):
    """The three largest namespaces; the limit is the feature."""
    found = search.stats(fixtures.knowledge(spark, d), top=3)
    rows = [(i, name, n, found["namespaces"], found["files"], found["symbols"]) for i, (name, n) in enumerate(found["topNamespaces"], 1)]
    return _frame(spark, rows, "place int, namespace string, n long, namespaces long, files long, symbols long")


@query(
    """SELECT 'Nation' || n_nationkey AS name, CAST((CASE WHEN n_nationkey = 12 THEN 10 ELSE 0 END) + 5 + (CASE WHEN n_nationkey = 1 THEN 5 WHEN n_nationkey >= 10 AND n_nationkey < 20 THEN 3 ELSE 0 END) AS INTEGER) AS score FROM nation"""
)
def q29_relevance(spark, d):
    """Points of symbols with members: the name's, equal or contained, and the members'."""
    found = ranking.score_symbols(fixtures.knowledge(spark, d).symbols, ranking.words_of("fix the neighbour, nation12: visit1", ranking.TASK_WORDS, 3))
    return found.select("name", "score")


@query(
    f"""SELECT {_FILE} AS file, CAST(10 + 5 + 3 AS BIGINT) AS score, 'Nation' || n_nationkey AS symbols FROM nation WHERE n_nationkey = 12"""
)
def q92_relevant_files(spark, d):
    found = ranking.relevant_files(fixtures.knowledge(spark, d), "fix Nation12 n12", exclude=["R1/*"])
    return found.select("file", "score", F.array_join("matchedSymbols", ",").alias("symbols"))


@query(
    """SELECT 'warning' AS kind, 'Region' || n_regionkey AS name, CAST(count(*) AS VARCHAR) AS value FROM nation GROUP BY n_regionkey HAVING count(*) >= 5 UNION ALL SELECT 'warning', 'INation', CAST(count(*) AS VARCHAR) FROM nation
    UNION ALL SELECT 'interface', 'INation', string_agg('Nation' || n_nationkey, ',' ORDER BY 'R' || n_regionkey || '/N' || n_nationkey || '.cs') FROM nation UNION ALL SELECT 'start', '1', 'INation, Size in Core/Regions.cs'"""
)
def q93_context(spark, d):
    """Who implements the interfaces of the files for a task, what many files use, and where to begin."""
    found = ranking.context(fixtures.knowledge(spark, d), "change ination, size and spot", max_files=1)
    rows = [("warning", w["symbol"], str(w["dependentCount"])) for w in found["warnings"]] + [("interface", m["interface"], ",".join(m["implementations"])) for m in found["interfaceMap"]]
    return _frame(spark, rows + [("start", str(i), s) for i, s in enumerate(found["startingPoints"], 1)], "kind string, name string, value string")


_ASKED = f"""SELECT 'Nation' || n_nationkey AS symbol, NULL AS member, CASE WHEN n_nationkey = 7 THEN 20 ELSE 0 END AS score FROM nation
UNION ALL SELECT 'Nation' || n_nationkey, 'neighbour', CASE WHEN {_NEXT} = 7 THEN 4 ELSE 0 END + 15 + 4 FROM nation"""


@query(f"SELECT symbol, member, CAST(score AS INTEGER) AS score FROM ({_ASKED}) WHERE score > 0")
def q94_question_scores(spark, d):
    return ranking.score_question(fixtures.knowledge(spark, d), "where is the neighbour of nation7").select("symbol", "member", "score")


@query(f"SELECT symbol || coalesce('.' || member, '') AS symbol, CAST(score AS BIGINT) AS score FROM ({_ASKED}) WHERE score > 19")
def q95_answer(spark, d):
    """The best places of an answer, those with more points than all the others have."""
    found = ranking.ask(fixtures.knowledge(spark, d), "where is the neighbour of nation7")
    return _frame(spark, [(f["symbol"], f["score"]) for f in found["files"] if f["score"] > 19], "symbol string, score long")


@query(f"SELECT 'Nation' || n_nationkey AS name, 'World.R' || n_regionkey AS namespace, 'Nation' || ((n_nationkey + 24) % 25) AS incoming, 'INation,Nation' || {_NEXT} || ',Region' || n_regionkey AS outgoing FROM nation WHERE n_nationkey = 7")
def q96_resolve_type(spark, d):
    kb = fixtures.knowledge(spark, d)
    region = kb.symbols.filter("name = 'Nation7'").first()["namespace"]
    found = graph.resolve_type(kb, f"{region}.Nation7, World", True)
    names = [",".join(sorted(r["name"] for r in found[s])) for s in ("incoming", "outgoing")]
    return _frame(spark, [(found["name"], found["namespace"], *names)], "name string, namespace string, incoming string, outgoing string")


# Output formats and surfaces ------------------------------------------------------------------------


@query("SELECT '{\"c_custkey\": ' || c_custkey || ', \"c_mktsegment\": \"' || c_mktsegment || '\"}' AS line FROM customer")
def q97_lines(spark, d):
    rows = data(spark, d, "customer").query(["c_custkey", "c_mktsegment"], limit=None).rows.collect()
    return _frame(spark, [(x,) for x in render.rows_lines(rows).splitlines()], "line string")


@query("SELECT CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 8) || '...' ELSE p_name END AS name, count(*) AS n FROM part GROUP BY 1")
def q98_truncated(spark, d):
    rows = table(spark, d, "part").groupBy("p_name").count().collect()  # a row a name
    found: dict[str, int] = {}
    for r in rows:
        name = render.truncated(r["p_name"], 8)
        found[name] = found.get(name, 0) + r["count"]
    return _frame(spark, list(found.items()), "name string, n long")


_SURFACE = "SELECT c_mktsegment AS key, count(*) AS count FROM customer GROUP BY 1"


def _groups(spark: SparkSession, out: dict) -> DataFrame:
    return _frame(spark, [(g["key"], g["count"]) for g in out["groups"]], "key string, count long")


def _tools(spark: SparkSession, d: str):
    from tessella.api import Tools

    return Tools(spark, fixtures.knowledge_dir(spark, d))


@query(_SURFACE)
def q99_api(spark, d):
    return _groups(spark, _tools(spark, d).call("group_by", file=f"{fixtures.game_files(spark, d)}/live.json", path="payload.segment")["result"])


@query(_SURFACE)
def q100_command_line(spark, d):
    from tessella import cli

    return _groups(spark, json.loads(cli.run(["group", f"{fixtures.game_files(spark, d)}/live.json", "payload.segment"], spark)))


@query(_SURFACE)
def q101_line_protocol(spark, d):
    from tessella.rpc import serve_lines

    arguments = {"file": f"{fixtures.game_files(spark, d)}/live.json", "path": "payload.segment"}
    request = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "group_by", "arguments": arguments}}
    sink = io.StringIO()
    serve_lines(_tools(spark, d), io.StringIO(json.dumps(request) + "\n"), sink)
    return _groups(spark, json.loads(json.loads(sink.getvalue())["result"]["content"][0]["text"]))


@query(f"SELECT 200 AS status, 'Nation' || n_nationkey AS name, {_FILE} AS file FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 404, NULL, NULL UNION ALL SELECT 200, 'world', NULL")
def q102_http(spark, d):
    from tessella.server import answer

    tools = _tools(spark, d)
    found = [answer(tools, "GET", f"/api/symbol/world/{n}", {}) for n in ("Nation4", "Nothing")]
    rows = [(status, out.get("name"), out.get("file")) for status, out in found]
    status, projects = answer(tools, "GET", "/api/projects", {})
    return _frame(spark, rows + [(status, p["name"], None) for p in projects], "status int, name string, file string")


@query("SELECT CAST(sum(c_nationkey) AS BIGINT) AS total, CAST(sum(c_nationkey) FILTER (WHERE c_nationkey > 3) AS BIGINT) AS some, count(*) FILTER (WHERE c_nationkey = 5) AS fives FROM customer")
def q103_map_values(spark, d):
    """Wildcards and keys of a typed map."""
    rows = Dataset.table(table(spark, d, "customer").select(F.create_map(F.lit("n"), F.col("c_nationkey").cast("long")).alias("m")))
    fives = rows.count("m[*] = 5").select(F.col("total").alias("fives"))
    totals = rows.df.agg(F.sum(rows.values("m.n").first()).alias("total"))
    some = rows.where("m[*] > 3")
    return totals.crossJoin(F.broadcast(some.df.agg(F.sum(some.values("m.n").first()).alias("some")))).crossJoin(F.broadcast(fives))  # a row each
