"""Dependency traversal: breadth-first by joins, a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.functions.keeping import kept
from tessella.symbols.store import KnowledgeBase

_REF = "name string, kind string, namespace string, file string, line int, depth int"


def expand(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within `depth` steps over edges (src, dst), each at its least depth; start (node) is depth 0.

    Each level is one join and one anti-join against what was visited, which is
    cached; the loop ends at the first empty level, so cycles end as well.
    """
    frontier = kept(start.select("node").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for level in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = kept(step.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return visited


def _refs(rows: DataFrame, depth: int) -> DataFrame:
    return rows.select("name", "kind", "namespace", F.col("relativePath").alias("file"), "line", F.lit(depth).alias("depth"), *[c for c in ("ord",) if c in rows.columns])


def outgoing(kb: KnowledgeBase, symbol: str, depth: int = 1) -> DataFrame:
    """Symbols that the file of `symbol` names, then those that their files name."""
    spark, symbols = kb.spark, kb.symbols
    names = spark.createDataFrame([(symbol,)], "node string")
    visited, found = names, None
    for level in range(1, depth + 1):
        # the file of the first symbol of each name, whatever its case
        wanted = names.select(F.lower("node").alias("low")).distinct()
        own = symbols.withColumn("low", F.lower("name")).join(wanted, "low").groupBy("low").agg(F.min(F.struct("relativePath", "at")).alias("first")).select("first.relativePath").distinct()
        types = kb.edges.join(own, "relativePath").groupBy("type").agg(F.min("type_at").alias("type_at"))
        hits = symbols.join(types, symbols["name"] == types["type"])
        if level > 1:
            hits = hits.join(visited.select(F.col("node").alias("name")), "name", "left_anti")
        hits = kept(hits)
        refs = _refs(hits.withColumn("ord", F.struct(F.lit(level), "type_at", "relativePath", "at")), level)
        found = refs if found is None else found.union(refs)
        names = hits.select(F.col("name").alias("node")).distinct().join(visited, "node", "left_anti")
        if names.isEmpty():
            break
        visited = visited.union(names).distinct()
    return found.orderBy("ord").drop("ord") if found is not None else spark.createDataFrame([], _REF)


def incoming(kb: KnowledgeBase, symbol: str, depth: int = 1) -> DataFrame:
    """All symbols of the files that name `symbol`, then of those that name any of these."""
    spark = kb.spark
    targets, files, found = spark.createDataFrame([(symbol,)], "type string"), None, None
    for level in range(1, depth + 1):
        now = kb.edges.join(targets, "type", "left_semi").select("relativePath").distinct()
        if files is not None:
            now = now.join(files, "relativePath", "left_anti")
        now = kept(now)
        if now.isEmpty():
            break
        files = now if files is None else files.union(now)
        hits = kb.symbols.join(now, "relativePath", "left_semi")
        refs = _refs(hits.withColumn("ord", F.struct(F.lit(level), "relativePath", "at")), level)
        found = refs if found is None else found.union(refs)
        targets = hits.select(F.col("name").alias("type")).distinct()
    return found.orderBy("ord").drop("ord") if found is not None else spark.createDataFrame([], _REF)


def dependencies(kb: KnowledgeBase, symbol: str, direction: str = "both", depth: int = 1, namespace: str | None = None) -> dict | None:
    """{symbol, namespace, file, incoming, outgoing, counts}; None for an unknown symbol (its case does not matter)."""
    rows = kb.symbols.filter(F.lower("name") == symbol.lower())
    rows = rows if namespace is None else rows.filter(F.col("namespace") == namespace)
    first = rows.orderBy("relativePath", "at").first()
    if first is None:
        return None
    into = [r.asDict() for r in incoming(kb, first["name"], depth).collect()] if direction in ("in", "both") else []
    out = [r.asDict() for r in outgoing(kb, first["name"], depth).collect()] if direction in ("out", "both") else []
    return {"symbol": first["name"], "namespace": first["namespace"], "file": first["relativePath"], "incoming": into, "outgoing": out, "counts": {"incoming": len(into), "outgoing": len(out)}}


def resolve_type(kb: KnowledgeBase, full_name: str, with_dependencies: bool = False) -> dict | None:
    """The symbol of a dotted type name; its dependencies are those of that very symbol, each name once."""
    from tessella.symbols.search import get_symbol

    namespace, _, name = full_name.split(",")[0].strip().rpartition(".")
    found = get_symbol(kb, name, namespace or None).first()
    if found is None:
        return None
    out = found.asDict(recursive=True)
    if with_dependencies:
        deps = dependencies(kb, name, "both", 1, found["namespace"])
        for side in ("incoming", "outgoing"):
            out[side] = list({r["name"]: r for r in deps[side]}.values()) if deps else []
    return out


def format_dependencies(deps: dict) -> str:
    """A tree of both directions."""
    lines = [f"{deps['symbol']} ({deps['file']})"]
    for side, mark in (("incoming", "<-"), ("outgoing", "->")):
        lines.append(f"  {side} ({deps['counts'][side]})")
        lines += [f"    {'  ' * (r['depth'] - 1)}{mark} {r['name']} [{r['kind']}] {r['file']}:{r['line']}" for r in deps[side]]
    return "\n".join(lines)
