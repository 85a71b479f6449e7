"""Entity files and a source tree made from the driver's tables, for the registered queries over such inputs.

They are written once a session below the folder that `spark.checkpoint.dir`
names (on one machine without it: a folder that goes with the process).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.symbols.store import KnowledgeBase, index_project

_made: dict[tuple[str, str, str], str] = {}


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/tessella-inputs-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tessella-inputs-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def _once(spark: SparkSession, sf_dir: str, kind: str, make) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _made:
        folder = _folder(spark)
        make(folder)
        _made[key] = folder
    return _made[key]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _text_file(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p)
    out.write(bytearray(text.encode()))
    out.close()


def write_document(rows: DataFrame, path: str, head: str, tail: str) -> None:
    """One JSON document of the lines `value` in the order of `at`: head, the rows with a comma before each, tail."""
    spark = rows.sparkSession
    ends = spark.createDataFrame([(-1, head), (None, tail)], "at long, value string")
    lines = rows.select("at", F.concat(F.lit(","), "value").alias("value")).union(ends)
    lines.repartition(1).sortWithinPartitions(F.col("at").asc_nulls_last()).select("value").write.text(path + ".parts")
    parts, fs = _fs(spark, path + ".parts")
    (part,) = [s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")]
    fs.rename(part, _fs(spark, path)[0])
    fs.delete(parts, True)


def _entity(kind: str, key: str, payload: Column) -> Column:
    return F.to_json(F.struct(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("entityId"), F.lit(f"Game.Model.{kind}, Game").alias("$type"), payload.alias("payload")))


def game_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with live.json (customers as players, every third of their orders a login) and chars.json (orders as characters), and list.json, an array of regions."""

    def make(folder: str) -> None:
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        orders = read("orders").withColumn("login", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("timestamp")))
        when = F.array_sort(F.collect_list(F.unix_millis("login")))
        own = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("PlayerCharacter:"), F.col("o_orderkey").cast("string")))).alias("ids"), when.alias("times"), F.min("login").alias("first"), F.max("login").alias("last"))
        iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        device = F.when(F.col("first").isNotNull(), F.array(F.struct(iso("first").alias("firstLogin"), iso("last").alias("lastLogin"))))
        payload = F.struct(
            F.col("c_name").alias("playerName"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.struct(F.coalesce("ids", F.array().cast("array<string>")).alias("characterIds")).alias("characterRoster"),
            device.alias("deviceHistory"), F.transform("times", lambda t: F.struct(t.alias("timestamp"))).alias("loginHistory"), F.struct(F.col("c_nationkey").alias("nation"), (F.col("c_nationkey") * 2).alias("twice")).alias("marks"),
        )
        players = read("customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("at"), _entity("Player", "c_custkey", payload).alias("value"))
        head = '{"meta": {"made": 1}, "entities": [{"entityId": "Guild:1", "payload": {"balance": null}}'
        write_document(players, f"{folder}/live.json", head, "]}")
        item = F.struct(F.col("l_quantity").alias("itemLevel"), F.col("l_partkey").alias("part"))
        worn = lambda test: F.collect_list(F.when(test, item))
        items = read("lineitem").groupBy("l_orderkey").agg(worn(F.col("l_linenumber") <= 2).alias("equippedItems"), worn(F.col("l_linenumber") == 3).alias("gear"))
        chars = read("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        payload = F.struct(
            F.concat(F.lit("Player:"), F.col("o_custkey").cast("string")).alias("playerId"), F.struct(F.col("o_orderpriority").alias("characterClassId")).alias("character"),
            F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 40).alias("level"), "equippedItems", F.array().cast("array<string>").alias("equipment"), "gear",
        )
        write_document(chars.select(F.col("o_orderkey").alias("at"), _entity("PlayerCharacter", "o_orderkey", payload).alias("value")), f"{folder}/chars.json", '{"entities": [{"entityId": "Npc:1"}', "]}")
        regions = read("region").select(F.col("r_regionkey").cast("long").alias("at"), F.to_json(F.struct("r_regionkey", "r_name")).alias("value"))
        write_document(regions, f"{folder}/list.json.txt", '[{"r_regionkey": -1}', "]")

    return _once(spark, sf_dir, "game", make)


#: The source of one nation's class: key, region's key, next nation's key, Unity message or other name.
NATION_SOURCE = """using System;
using World.Core;

namespace World.R{region}
{{
    [Serializable]
    public class Nation{key} : Region{region}, INation
    {{
        public Nation{next} neighbour;
        private int hidden;
        public string Title {{ get; private set; }}
        protected void Visit{key}(Region{region} target, int times) {{ Debug.Log(target); }}
        private void {message}() {{ }}
    }}
}}
"""
CORE_SOURCE = """namespace World.Core
{{
    public interface INation {{ }}
    public enum Size {{ Small, Large }}
    public struct Spot {{ public int x; }}
{regions}}}
"""


def sources(spark: SparkSession, sf_dir: str) -> str:
    """A tree of C# files: a class for each of the 25 nations, a file with the regions, one without namespace, and files to be ignored."""

    def make(folder: str) -> None:
        nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()  # 25 rows at every scale
        for n in nations:
            key, region = n["n_nationkey"], n["n_regionkey"]
            text = NATION_SOURCE.format(key=key, region=region, next=(key + 1) % 25, message="Prepare" if key % 2 else "Awake")
            _text_file(spark, f"{folder}/R{region}/N{key}.cs", text)
        regions = sorted(r["r_regionkey"] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey").collect())
        _text_file(spark, f"{folder}/Core/Regions.cs", CORE_SOURCE.format(regions="".join(f"    public class Region{r} {{ public int size; }}\n" for r in regions)))
        _text_file(spark, f"{folder}/Globals.cs", "public class Globals { }\n")
        for path in ("bin/Built.cs", "Gen/Made.cs", "Core/notes.txt", "old.tmp.cs"):
            _text_file(spark, f"{folder}/{path}", "class Skipped { }\n")
        _text_file(spark, f"{folder}/.gitignore", "# made\nGen/\n*.tmp.cs\n")

    return _once(spark, sf_dir, "sources", make)


def knowledge_dir(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the indexed project `world`."""
    return _once(spark, sf_dir, "kb", lambda folder: index_project(spark, sources(spark, sf_dir), "world", folder))


def knowledge(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    return KnowledgeBase.open(spark, knowledge_dir(spark, sf_dir), "world")
