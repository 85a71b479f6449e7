"""The knowledge base: Parquet tables of indexed projects, and the JSON layout for exchange."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.symbols import extractor
from tessella.symbols.model import FILE_SYMBOLS, FILES, META

#: Directories that are never indexed.
IGNORED = ("node_modules", ".git", "bin", "obj", "Library", "Temp", "Logs", "Build")


def _ignored(relative: Column, patterns: list[str]) -> Column:
    """Whether a path has an ignored part: a name, a name with *, or a path from the root."""
    out = relative.rlike(r"(^|/)\.")
    for p in patterns:
        p = p.strip()
        if not p or p[0] in "#!":
            continue
        anchored, body = p.startswith("/") or "/" in p.rstrip("/"), p.strip("/")
        regex = "".join(".*" if x == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else "\\" + x if x in ".+()[]{}^$|\\" else x for x in _parts(body))
        out = out | relative.rlike(("^" if anchored else "(^|/)") + regex + ("/" if p.endswith("/") else "(/|$)"))
    return out


def _parts(pattern: str) -> list[str]:
    out, i = [], 0
    while i < len(pattern):
        n = 2 if pattern[i : i + 2] == "**" else 1
        out.append(pattern[i : i + n])
        i += n
    return out


def scan_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".cs",), exclude: list[str] | None = None, gitignore: bool = True) -> DataFrame:
    """(path, relativePath, size, lastModified, content) of the source files below a directory, without what is ignored."""
    patterns = list(exclude or [])
    if gitignore:
        patterns += IGNORED
        patterns += _text(spark, f"{root.rstrip('/')}/.gitignore").splitlines()
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(extensions) + "}").load(root)
    relative = F.substring(F.col("path"), F.lit(len(full) + 2), F.length("path"))
    rows = files.withColumn("relativePath", relative).filter(~_ignored(F.col("relativePath"), patterns))
    return rows.select("path", "relativePath", F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("lastModified"), "content")


def _text(spark: SparkSession, path: str) -> str:
    """A small file that Spark's sources skip as hidden; empty if it is missing."""
    if not _exists(spark, path):
        return ""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def namespace_rows(file_symbols: DataFrame) -> DataFrame:
    """(namespace, name, kind, file, line) of each symbol, `_global` for no namespace; a large one is many rows, not one long list."""
    rows = file_symbols.select("relativePath", F.inline("symbols"))
    return rows.select(F.coalesce("namespace", F.lit("_global")).alias("namespace"), "name", "kind", F.col("relativePath").alias("file"), "line")


def namespaces(file_symbols: DataFrame) -> DataFrame:
    """(namespace, files, symbols) of each namespace for the JSON layout, which has them as lists."""
    rows = namespace_rows(file_symbols).withColumn("relativePath", F.col("file")).drop("file")
    return rows.groupBy("namespace").agg(
        F.sort_array(F.collect_set("relativePath")).alias("files"),
        F.sort_array(F.collect_list(F.struct("name", "kind", F.col("relativePath").alias("file"), "line"))).alias("symbols"),
    )


def index_project(spark: SparkSession, path: str, name: str, data_dir: str, exclude: list[str] | None = None, extensions: tuple[str, ...] = (".cs",)) -> KnowledgeBase:
    """Scan, extract, and write the tables of a project, in place of what was there."""
    sources = scan_sources(spark, path, extensions, exclude)
    home = f"{data_dir.rstrip('/')}/{name}"
    root = f"{data_dir.rstrip('/')}/.{name}-{uuid.uuid4().hex}"  # readers see the old tables until all new ones are there
    extractor.extract(sources).write.mode("overwrite").parquet(f"{root}/by-file")
    found = spark.read.schema(FILE_SYMBOLS).parquet(f"{root}/by-file")
    counts = found.select("relativePath", F.size("symbols").alias("symbolCount"))
    manifest = sources.select("path", "relativePath", "size", "lastModified", F.substring(F.sha2("content", 256), 1, 16).alias("hash")).join(counts, "relativePath")
    manifest.select(*FILES.fieldNames()).write.mode("overwrite").parquet(f"{root}/files")
    namespace_rows(found).repartitionByRange("namespace", "file").write.mode("overwrite").parquet(f"{root}/by-namespace")
    totals = found.agg(F.count("*").cast("int"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).cast("int")).first()
    now = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    spark.createDataFrame([(name, path, now, *totals)], META).coalesce(1).write.mode("overwrite").parquet(f"{root}/meta")
    _swap(spark, root, home)
    return KnowledgeBase.open(spark, data_dir, name)


def _swap(spark: SparkSession, new: str, home: str) -> None:
    """Put a finished folder in the place of an old one, by two renames."""
    old = f"{new}-old"
    new_at, home_at, old_at = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (new, home, old))
    fs = home_at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(home_at):
        fs.rename(home_at, old_at)
    if not fs.rename(new_at, home_at):
        raise OSError(f"could not move {new} to {home}")
    fs.delete(old_at, True)


def list_projects(spark: SparkSession, data_dir: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(data_dir)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith(".")) if fs.exists(p) else []


class KnowledgeBase:
    """Tables of one project: file_symbols and files, with meta."""

    def __init__(self, spark: SparkSession, file_symbols: DataFrame, files: DataFrame | None = None, meta: dict | None = None):
        self.spark, self.files, self.meta = spark, files, meta or {}
        # a file's place in the manifest order, which "first" refers to
        self.file_symbols = file_symbols if files is None else file_symbols.join(files.select("relativePath"), "relativePath", "left_semi")

    @classmethod
    def open(cls, spark: SparkSession, data_dir: str, name: str) -> KnowledgeBase:
        root = f"{data_dir.rstrip('/')}/{name}"
        if not _exists(spark, f"{root}/meta"):
            raise FileNotFoundError(f"Project not found: {name}")
        meta = spark.read.schema(META).parquet(f"{root}/meta").first().asDict()
        return cls(spark, spark.read.schema(FILE_SYMBOLS).parquet(f"{root}/by-file"), spark.read.schema(FILES).parquet(f"{root}/files"), meta)

    @classmethod
    def from_json(cls, spark: SparkSession, root: str) -> KnowledgeBase:
        """The JSON layout: meta.json, files.json and symbols/by-file/*.json."""
        read = lambda schema, at: spark.read.schema(schema).option("multiLine", True).json(f"{root}/{at}")
        return cls(spark, read(FILE_SYMBOLS, "symbols/by-file"), read(FILES, "files.json"), read(META, "meta.json").first().asDict())

    def to_json(self, root: str) -> None:
        """Export in the JSON layout, a file for each row."""

        def put(df: DataFrame, at: str) -> None:
            df.write.mode("overwrite").option("maxRecordsPerFile", 1).json(f"{root}/{at}")

        put(self.file_symbols, "symbols/by-file")
        put(namespaces(self.file_symbols), "symbols/by-namespace")
        if self.files is not None:
            put(self.files, "files.json")
        if self.meta:
            put(self.spark.createDataFrame([tuple(self.meta.get(n) for n in META.fieldNames())], META).coalesce(1), "meta.json")

    @cached_property
    def symbols(self) -> DataFrame:
        """A row per symbol: its fields, relativePath (the files' order) and at (its place in the file)."""
        rows = self.file_symbols.select("relativePath", F.posexplode("symbols").alias("at", "s"))
        return rows.select("relativePath", "at", "s.*")

    @cached_property
    def members(self) -> DataFrame:
        """A row per member, with its symbol's name, namespace and place."""
        rows = self.symbols.select("relativePath", "at", F.col("name").alias("symbol"), F.col("kind").alias("symbolKind"), "namespace", F.posexplode("members").alias("member_at", "m"))
        return rows.select("relativePath", "at", "member_at", "symbol", "symbolKind", "namespace", "m.*")

    @cached_property
    def edges(self) -> DataFrame:
        """(relativePath, type, type_at): names that a file uses."""
        return self.file_symbols.select("relativePath", F.posexplode("dependencies.types").alias("type_at", "type"))

    def cache(self) -> KnowledgeBase:
        self.file_symbols = self.file_symbols.cache()
        return self


def meta_json(meta: dict) -> str:
    return json.dumps(meta, indent=2, ensure_ascii=False)
