"""Entity collections: JSON documents whose top-level array holds the rows."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.sources import json_split


@dataclass(frozen=True)
class JsonFile:
    path: str
    name: str
    size: int

    @property
    def megabytes(self) -> float:
        return self.size / 1048576


def _local(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def find_json_files(spark: SparkSession, directory: str) -> list[JsonFile]:
    """The *.json files right in a directory, by name, in any file system that Spark reads."""
    p, fs = _local(spark, directory)
    if not fs.exists(p):
        return []
    found = [s for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(".json")]
    return sorted((JsonFile(s.getPath().toString(), s.getPath().getName(), s.getLen()) for s in found), key=lambda f: f.name)


def validate_file(spark: SparkSession, path: str) -> str:
    """The path if it is an existing file; raises otherwise, before any plan is made."""
    p, fs = _local(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"File not found: {path}")
    if not fs.getFileStatus(p).isFile():
        raise IsADirectoryError(f"Not a file: {path}")
    return path


#: Bytes of a document whose rows make one partition.
PART_BYTES = 32 << 20


def _parts(spark: SparkSession, path: str) -> int:
    p, fs = _local(spark, path)
    return -(-fs.getContentSummary(p).getLength() // PART_BYTES)


def _divisible(spark: SparkSession, path: str) -> bool:
    """Whether a path is one large plain file in UTF-8, whose parts can be read."""
    p, fs = _local(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isFile() or fs.getFileStatus(p).getLen() <= json_split.SPLIT_BYTES:
        return False
    if spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(p) is not None:
        return False
    stream = fs.open(p)
    try:
        head = [stream.read() for _ in range(4)]
    finally:
        stream.close()
    return 0 not in head and head[0] not in (0xFE, 0xFF)  # UTF-16 and UTF-32 have either


def read_entities(spark: SparkSession, path: str, root: str = "entities", partitions: int | None = None) -> DataFrame:
    """(pos, entity): one row per element of the array at `root`; a file without it has no rows, another type there fails.

    Each element is a VARIANT of its own, since one VARIANT of a whole large file
    exceeds the size limit. A large document is cut into its elements by many tasks
    (`json_split`), which takes a scan when it is opened and two when it is read;
    keep a Parquet copy for repeated queries. One that cannot be cut is parsed by one
    task, and its rows are dealt out, by default to a partition for each PART_BYTES.
    """
    name = root.replace("`", "")
    if _divisible(spark, path) and (found := json_split.elements(spark, path, name)) is not None:
        blank = F.raise_error(F.lit(f"no element between two commas in {path}"))
        one = F.from_json(F.concat(F.lit('{"v":['), "text", F.lit("]}")), "v array<variant>", {"mode": "FAILFAST"})["v"]
        # a generator, so that the text is parsed once, however many values of it are asked for
        out = found.select("pos", F.explode(F.when(F.col("text").rlike(r"^\s*$"), blank.cast("array<variant>")).otherwise(one)).alias("entity"))
        return out.repartition(partitions) if partitions else out
    rows = spark.read.schema(f"`{name}` ARRAY<VARIANT>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = rows.select(F.posexplode(F.col(f"`{name}`")).alias("pos", "entity")).select(F.col("pos").cast("long"), "entity")
    partitions = partitions or _parts(spark, path)
    return out.repartition(partitions) if partitions > 1 else out


#: What the messages of failures say that are the machines' and not the file's.
_NOT_THE_FILE = ("ExecutorLost", "executor lost", "OutOfMemory", "UNABLE_TO_ACQUIRE_MEMORY", "MetadataFetchFailed", "FetchFailed", "No space left", "SparkContext", "cancelled", "maxResultSize")


def blame_file(e: Exception) -> str:
    """The first line of why a file could not be read; raises again what is no fault of the file, so that it never looks empty."""
    if isinstance(e, MemoryError) or any(x in str(e) for x in _NOT_THE_FILE):
        raise e
    return str(e).splitlines()[0]


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """(pos, entity) of a file whose document is itself an array, or of a single value."""
    text = spark.read.text(path, wholetext=True)
    # each element is a VARIANT of its own; only another kind of document is one as a whole
    is_array = F.col("value").rlike(r"^\s*\[")
    elements = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v array<variant>", {"mode": "FAILFAST"})["v"]
    items = F.when(is_array, elements).otherwise(F.array(F.parse_json(F.when(~is_array, F.col("value")))))
    out = text.select(F.posexplode(items).alias("pos", "entity")).select(F.col("pos").cast("long"), "entity")
    partitions = _parts(spark, path)
    return out.repartition(partitions) if partitions > 1 else out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, entity) of newline-delimited JSON, which Spark splits; pos orders the rows but has gaps."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    return lines.select(F.monotonically_increasing_id().alias("pos"), F.parse_json("value").alias("entity"))


def store_entities(entities: DataFrame, path: str) -> None:
    """A Parquet copy of an entity collection."""
    entities.write.mode("overwrite").parquet(path)


def base_name(path: str) -> str:
    return PurePosixPath(path).name
