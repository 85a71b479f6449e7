"""Discovery: id fields, relationships between datasets, schema profiles, dataset descriptions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tessella.functions import paths
from tessella.functions.keeping import kept, letting_go
from tessella.functions.paths import VariantBackend
from tessella.functions.rounding import rounded
from tessella.operators.dataset import Dataset
from tessella.sources import json_files, json_split

#: Levels that ids and schemas are looked for in.
ID_LEVELS = 20
#: Levels that one expression opens.
AT_ONCE = 20
#: Names of id fields, form of typed ids, the forms of text that are named, and of id values.
ID_NAMES = (r"Id$", r"Ids$", r"id$", r"ids$", r"(?i)entityId", r"(?i)^id$")
TYPED_ID = r"^[A-Z][a-zA-Z]+:[0-9A-Fa-f]+$"
PREFIXED, DATE_TEXT, GUID = r"^[A-Za-z]+:[A-Za-z0-9]+$", r"^\d{4}-\d{2}-\d{2}", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
LONG_HEX, DIGITS = r"^[0-9A-Fa-f]{16,}$", r"^\d+$"
KEY_FIELD = re.compile(r"Id$|Ids$|^id$|^entityId$", re.I)
METRIC_NAMES = ("History", "Stats", "createdAt", "updatedAt", "timestamp", "count", "total")


def is_id_name(name: str) -> bool:
    return any(re.search(p, name) for p in ID_NAMES)


# Ids ------------------------------------------------------------------------------------------------


def _typed_ids(schema: T.StructType) -> list[tuple[str, Column, T.DataType, bool]]:
    """(path, column, type, whether the name is an id's) of every scalar in the schema; columns are arrays."""
    out = []

    def walk(path: str, column: Column, dtype: T.DataType, name: str, level: int, many: bool) -> None:
        if level > ID_LEVELS:
            return
        as_many = lambda c: c if many else F.array(c)
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                inner = (lambda n: lambda x: x.getField(n))(f.name)
                below = F.transform(column, inner) if many else column.getField(f.name)
                # {value: x} stands for x
                if f.name == "value" and len(dtype.fields) == 1:
                    walk(path, below, f.dataType, name, level + 1, many)
                else:
                    walk(f"{path}.{f.name}", below, f.dataType, f.name, level + 1, many)
        elif isinstance(dtype, T.ArrayType):
            spread = F.flatten(F.filter(column, lambda x: x.isNotNull())) if many else F.coalesce(column, F.array().cast(dtype))
            walk(path + "[*]", spread, dtype.elementType, name, level + 1, True)
        elif isinstance(dtype, (T.StringType, *paths._NUMBERS)):
            out.append((path, as_many(column), dtype, is_id_name(name)))

    for f in schema.fields:
        walk(f.name, F.col(f"`{f.name}`"), f.dataType, f.name, 0, False)
    return out


def _shown(dtype: T.DataType):
    return lambda v: F.when(v.isNotNull(), paths.key_text(v, dtype))


def _kept(named: bool):
    return lambda t: t.isNotNull() & (t != "") & (F.lit(True) if named else t.rlike(TYPED_ID))


def _at(path: str):
    return lambda t: F.struct(F.lit(path).alias("path"), t.alias("value"))


def _typed_id_values(df: DataFrame) -> DataFrame:
    parts = []
    for path, column, dtype, named in _typed_ids(df.schema):
        if not named and not isinstance(dtype, T.StringType):
            continue
        texts = F.transform(column, _shown(dtype))
        kept = F.filter(texts, _kept(named))
        parts.append(F.transform(kept, _at(path)))
    if not parts:
        return df.sparkSession.createDataFrame([], "path string, value string")
    return df.select(F.inline(F.concat(*parts) if len(parts) > 1 else parts[0]))


def _heights(rows: DataFrame, column: str) -> int:
    """Levels of objects and arrays in the rows."""
    texts = rows.select(F.to_json(column).alias("text")).filter("text is not null")
    return texts.mapInArrow(json_split.heights, "height int").agg(F.max("height")).first()[0] or 0


def _opened(path: Column, name: Column, item: Column, v: Column, at: int, last: int) -> Column:
    """The nodes of a variant on level `at` and below, down to level `last`; its children are named once, so that the expression grows with the levels."""
    own = F.array(F.struct(F.lit(at).alias("level"), path.alias("path"), name.alias("name"), item.alias("item"), v.alias("v")))
    if at == last:
        return own
    inner = lambda p, n, i, x: F.struct(p.alias("path"), n.alias("name"), F.lit(i).alias("item"), x.alias("v"))
    start = F.when(path == "", "").otherwise(F.concat(path, F.lit(".")))
    fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: inner(F.concat(start, e["key"]), e["key"], False, e["value"]))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: inner(F.concat(path, F.lit("[*]")), name, True, x))
    below = F.flatten(F.transform(F.coalesce(fields, items), lambda c: _opened(c["path"], c["name"], c["item"], c["v"], at + 1, last)))
    return F.coalesce(F.concat(own, below), own)


def nodes(rows: DataFrame, column: str, levels: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(level, path, name, item, v) of every variant in the column down to a level, with the columns to keep; an array's element is an item and has its name.

    One pass, in which AT_ONCE levels are opened by one expression; only for more
    levels than that are the rows' own levels counted first. A row without a variant
    is one node. (For an inner generator, the planner would test for empty arrays by
    making them twice more.)
    """
    if levels > AT_ONCE:
        levels = min(levels, _heights(rows, column))
    now = rows.select(*keep, F.inline_outer(_opened(F.lit(""), F.lit(""), F.lit(False), F.col(column), 0, min(levels, AT_ONCE))))
    for at in range(AT_ONCE, levels, AT_ONCE):
        own = [F.col(c) for c in ("path", "name", "item", "v")]
        opened = F.when(F.col("level") == at, _opened(*own, at, min(levels, at + AT_ONCE)))
        now = now.select(*keep, F.inline_outer(opened.otherwise(F.array(F.struct("level", *own)))))
    return now


def _once(rows: DataFrame, keep: tuple[str, ...], column: Column, name: str) -> DataFrame:
    """The columns to keep and one more, which is computed once, however often it is used."""
    return rows.select(*keep, F.explode_outer(F.array(column)).alias(name))


def _variant_id_values(df: DataFrame, column: str) -> DataFrame:
    names = "|".join(f"({p})" for p in ID_NAMES)
    v, boxed, fields = F.col("v"), F.try_variant_get("v", "$.value", "variant"), F.try_variant_get("v", "$", "map<string,variant>")
    # the most are no boxes, which the first test shows
    rows = _once(nodes(df, column, ID_LEVELS).filter("v is not null"), ("path", "name"), F.when(boxed.isNotNull(), F.when(F.size(fields) == 1, boxed).otherwise(v)).otherwise(v), "v")
    # a type is told by all that is inside, so objects and arrays are not asked for it
    alone = fields.isNull() & F.try_variant_get("v", "$", "array<variant>").isNull()
    rows = _once(rows, ("path", "name", "v"), F.when(alone, F.schema_of_variant(v)), "tag").filter("tag is not null")
    tag = F.col("tag")
    text = F.coalesce(paths.as_text(v, paths.VARIANT, tag), paths.number_text(paths.as_number(v, paths.VARIANT, tag)))
    rows = _once(rows.filter(F.col("name").rlike(names) | (tag == "STRING")), ("path", "name"), text, "value").filter("value is not null and value <> ''")
    return rows.filter(F.col("name").rlike(names) | F.col("value").rlike(TYPED_ID)).select("path", "value")


def id_values(data: Dataset) -> DataFrame:
    """Distinct (path, value) of all id fields: named like one, or with values of the form Type:hex."""
    df = _variant_id_values(data.df, data.backend.column) if isinstance(data.backend, VariantBackend) else _typed_id_values(data.df)
    return df.distinct()


def id_fields(data: Dataset, ids: DataFrame | None = None) -> DataFrame:
    """(path, n, form) of the id fields: their distinct values, and what all of those look like.

    form is `Kind:*` if all values are typed ids of one kind, `EntityId:*` if of
    several, `hex-id` for 16 hex digits or more, `numeric-id`, or NULL.
    """
    value, kind = F.col("value"), F.substring_index("value", ":", 1)
    every = lambda pattern: F.bool_and(value.rlike(pattern))
    one = F.min(kind) == F.max(kind)
    typed = F.when(one, F.concat(F.min(kind), F.lit(":*"))).otherwise("EntityId:*")
    form = F.when(every(TYPED_ID), typed).when(every(LONG_HEX), "hex-id").when(every(DIGITS), "numeric-id")
    return (id_values(data) if ids is None else ids).groupBy("path").agg(F.count("*").alias("n"), form.alias("form"))


def text_form(text: Column) -> Column:
    """What a text looks like: its own prefix with `:xxx`, ISO date, GUID, or NULL."""
    return F.when(text.rlike(PREFIXED), F.concat(F.substring_index(text, ":", 1), F.lit(":xxx"))).when(text.rlike(DATE_TEXT), "ISO date").when(text.rlike(GUID), "GUID")


def find_relationships(left: Dataset, right: Dataset, min_coverage: float = 50, ids: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(left_path, right_path, matched, left_count, right_count, coverage, kind), best coverage first."""
    a, b = (x.select(F.lit(side).alias("file"), "path", "value") for side, x in enumerate(ids or (id_values(left), id_values(right))))
    return _related(_pairs(a.union(b)), min_coverage).drop("left_file", "right_file").orderBy(F.desc("coverage"), "left_path", "right_path")


def _pairs(ids: DataFrame) -> DataFrame:
    """(left_file, left_path, right_file, right_path, matched, left_count, right_count) of the id fields of different files that share values.

    `ids` are distinct (file, path, value) and are read once: the places of each value
    are paired with each other and with themselves, which counts the fields too.
    """
    places = ids.groupBy("value").agg(F.collect_list(F.struct("file", "path")).alias("places"))
    left = places.select("places", F.explode("places").alias("left"))
    both = left.select("left", F.explode(F.filter("places", lambda p: (p["file"] > F.col("left.file")) | (p == F.col("left")))).alias("right"))
    counts = both.groupBy("left", "right").agg(F.count("*").alias("matched"))  # a row per pair of fields
    own = F.max(F.when(F.col("left") == F.col("right"), F.col("matched")))
    for side in ("left", "right"):
        counts = counts.withColumn(f"{side}_count", own.over(Window.partitionBy(side)))
    named = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("left", "right") for c in ("file", "path")]
    return counts.filter(F.col("left.file") < F.col("right.file")).select(*named, "matched", "left_count", "right_count")


def _related(pairs: DataFrame, min_coverage: float) -> DataFrame:
    """Pairs of paths with their coverage, if it is enough, and kind."""
    many_left, many_right = F.contains(F.col("left_path"), F.lit("[*]")), F.contains(F.col("right_path"), F.lit("[*]"))
    kind = (
        F.when(many_left & many_right, "many-to-many").when(many_left, "one-to-many").when(many_right, "many-to-one").when(F.col("left_count") == F.col("right_count"), "one-to-one").otherwise("many-to-one")
    )
    return pairs.withColumn("coverage", F.col("matched") / F.col("left_count") * 100).filter(F.col("coverage") >= min_coverage).withColumn("kind", kind)


# Schema ---------------------------------------------------------------------------------------------


@dataclass
class SchemaNode:
    """One place of the inferred schema."""

    type: str
    clr_type: str | None = None
    properties: dict[str, SchemaNode] = field(default_factory=dict)
    items: SchemaNode | None = None
    array_length: tuple[int, int] | None = None
    pattern: str | None = None
    examples: list[str] = field(default_factory=list)
    optional: bool = False

    def to_json(self) -> dict:
        out: dict = {"type": self.type}
        if self.clr_type:
            out["$type"] = self.clr_type
        if self.properties:
            out["properties"] = {k: v.to_json() for k, v in self.properties.items()}
        if self.items:
            out["items"] = self.items.to_json()
        if self.array_length:
            out["arrayLength"] = {"min": self.array_length[0], "max": self.array_length[1]}
        if self.pattern:
            out["pattern"] = self.pattern
        if self.examples:
            out["examples"] = self.examples
        if self.optional:
            out["optional"] = True
        return out


def profile(data: Dataset, max_depth: int = 10, max_examples: int = 3) -> DataFrame:
    """(path, kind, n, parents, least, most, pattern, examples) of every path; path `` is the row itself.

    kind is the most frequent type there (object, array, string, number, boolean,
    null). All rows are looked at, in one aggregate.
    """
    column = data.backend.column if isinstance(data.backend, VariantBackend) else "entity"
    rows = data.df if isinstance(data.backend, VariantBackend) else data.df.select(F.to_variant_object(F.struct("*")).alias("entity"))
    v, tag = F.col("v"), F.col("tag")
    pattern = text_form(F.col("text"))
    items, fields = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
    seen = nodes(rows, column, max_depth).filter("v is not null").select("level", "path", "v", F.when(items.isNotNull(), F.size(items)).alias("size"), fields.isNotNull().alias("is_object"))
    is_array, is_object = F.col("size").isNotNull(), F.col("is_object")
    # the type of a value without others inside, asked for once
    seen = seen.select("*", F.when(~(is_array | is_object), F.schema_of_variant(v)).alias("tag"))
    kind = F.when(is_array, "array").when(is_object, "object").when(F.is_variant_null(v), "null").when(tag == "STRING", "string").when(tag == "BOOLEAN", "boolean").otherwise("number")
    text, clr = paths.as_text(v, paths.VARIANT, tag), F.when(is_object, F.try_variant_get(v, '$["$type"]', "string"))
    facts = seen.select("level", "path", kind.alias("kind"), "size", text.alias("text"), clr.alias("clr"), F.when(tag.isNotNull(), paths.key_text(v, paths.VARIANT, tag)).alias("shown"))
    shown = F.when((F.length("shown") <= 50) & (F.col("kind") != "null"), F.col("shown"))
    return facts.groupBy("level", "path").agg(
        F.mode("kind", True).alias("kind"), F.count("*").alias("n"), F.count_if(F.col("kind") == "object").alias("objects"),
        F.min("size").alias("least"), F.max("size").alias("most"), F.min(pattern).alias("pattern"), F.min("clr").alias("clr_type"),
        # the least and greatest texts: a bounded, order-free choice of examples
        F.slice(F.array_distinct(F.array_compact(F.array(F.min(shown), F.max(shown), F.max_by(shown, F.xxhash64("shown"))))), 1, max_examples).alias("examples"),
    ).drop("level")


def infer_schema(data: Dataset, max_depth: int = 10, max_examples: int = 3, patterns: bool = True) -> SchemaNode:
    """The schema tree of a dataset; `optional` marks fields that some object at that place lacks."""
    rows = {r["path"]: r for r in profile(data, max_depth, max_examples).collect()}  # one row per path
    nodes: dict[str, SchemaNode] = {}
    for path in sorted(rows, key=lambda p: (p.count(".") + p.count("[*]"), p)):
        r = rows[path]
        node = nodes[path] = SchemaNode(r["kind"], r["clr_type"] if r["kind"] == "object" else None)
        if r["kind"] == "array":
            node.array_length = (r["least"], r["most"])
        elif r["kind"] not in ("object", "null") and patterns:
            node.pattern, node.examples = r["pattern"], list(r["examples"] or [])
        if not path:
            continue
        if path.endswith("[*]"):
            parent = nodes.get(path[:-3])
            if parent and parent.type == "array":
                parent.items = node
        else:
            above = path.rpartition(".")[0]
            parent = nodes.get(above)
            if parent and parent.type == "object":
                parent.properties[path.rpartition(".")[2]] = node
                node.optional = r["n"] < rows[above]["objects"]
    return nodes.get("", SchemaNode("null"))


# Dataset description --------------------------------------------------------------------------------


@dataclass
class FileDescription:
    name: str
    size_mb: float
    count: int = 0
    entity_type: str | None = None
    key_fields: list[str] = field(default_factory=list)
    sample_values: dict[str, list[str]] = field(default_factory=dict)
    metrics: list[str] = field(default_factory=list)
    error: str | None = None


@dataclass
class DatasetDescription:
    directory: str
    files: list[FileDescription]
    relationships: list[dict]
    suggested_queries: list[str]


def walk_nodes(node: SchemaNode, path: str = ""):
    """(path, name, node) of every property below a node."""
    for name, child in node.properties.items():
        here = f"{path}.{name}" if path else name
        yield here, name, child
        yield from walk_nodes(child, here)
    if node.items:
        yield from walk_nodes(node.items, path + "[*]")


def metadata(node: SchemaNode) -> tuple[str | None, list[str], dict[str, list[str]], list[str]]:
    """Entity type, key fields, sample values and metric fields that a schema shows."""
    kind = node.clr_type or (node.items.clr_type if node.items else None)
    places = list(walk_nodes(node))
    keys = [p for p, name, _ in places if KEY_FIELD.search(name)]
    samples = {p: [x for x in n.examples[:5] if len(x) < 50] for p, _, n in places if n.type == "string" and n.examples}
    metrics = [p for p, name, n in places if n.type == "number" or any(m in name for m in METRIC_NAMES)]
    return (kind.split(",")[0].rsplit(".", 1)[-1] if kind else None), keys, {k: v for k, v in samples.items() if v}, metrics[:10]


def suggestions(files: list[FileDescription], relationships: list[dict]) -> list[str]:
    """At most five hints: a grouping and a history query for each file, a join for each relationship."""
    out: list[str] = []
    for f in files:
        if several := next((p for p, v in f.sample_values.items() if len(v) >= 2), None):
            out.append(f"Group by {several} in {f.name}")
        if past := next((m for m in f.metrics if "History" in m or "Stats" in m), None):
            out.append(f"Analyze {past} in {f.name}")
    out += [f"Join {r['left_file']} with {r['right_file']} on {r['left_path']} = {r['right_path']}" for r in relationships]
    return list(dict.fromkeys(out))[:5]


def all_relationships(ids: DataFrame, min_coverage: float = 50) -> DataFrame:
    """The relationships between all files in `ids` (file, path, value): as `find_relationships`, with left_file and right_file."""
    return _related(_pairs(ids), min_coverage).orderBy("left_file", "right_file", F.desc("coverage"), "left_path", "right_path")


def describe_dataset(spark: SparkSession, directory: str, min_coverage: float = 50) -> DatasetDescription:
    """Every JSON file of a directory, with the relationships between them; each file is parsed once."""
    files, ids = [], None
    with letting_go():
        for f in json_files.find_json_files(spark, directory):
            about = FileDescription(f.name, rounded(f.megabytes, 2))
            try:
                data = Dataset.variants(kept(json_files.read_entities(spark, f.path)))
                about.count = data.count().first()["total"]
                about.entity_type, about.key_fields, about.sample_values, about.metrics = metadata(infer_schema(data))
                own = id_values(data).select(F.lit(f.name).alias("file"), "path", "value")
                ids = own if ids is None else ids.union(own)
            except Exception as e:  # an unreadable file is described as empty
                about.error = json_files.blame_file(e)
            files.append(about)
        found = [] if ids is None else [r.asDict() for r in all_relationships(ids, min_coverage).collect()]
    return DatasetDescription(directory, files, found, suggestions(files, found))
