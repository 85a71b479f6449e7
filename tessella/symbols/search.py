"""Search, lookup, statistics and export over the knowledge base. Limits: None returns all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.symbols.store import KnowledgeBase

DEFAULT_LIMIT = 50
_ORDER = ("relativePath", "at")


def _prefix(column: Column, prefix: str | None) -> Column:
    return F.lit(True) if not prefix else F.coalesce(column.startswith(prefix), F.lit(False))


def _cut(rows: DataFrame, order: tuple[str, ...], limit: int | None, drop: tuple[str, ...]) -> DataFrame:
    rows = rows.orderBy(*order)
    return (rows if limit is None else rows.limit(limit)).drop(*drop)


def search(kb: KnowledgeBase, query: str, kind: str | None = None, namespace: str | None = None, path: str | None = None, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """(symbol, kind, namespace, file, line, match): case-insensitive substring of names, member names or signatures.

    `kind` is that of symbols; members of other kinds of symbols are looked at all the same.
    """
    q = query.lower()
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    here = lambda df: df.filter(_prefix(F.col("namespace"), namespace) & _prefix(F.col("relativePath"), path))
    symbols = here(kb.symbols).filter(has(F.col("name")) & (F.lit(True) if kind is None else F.col("kind") == kind))
    symbols = symbols.select("relativePath", "at", F.lit(-1).alias("member_at"), F.col("name").alias("symbol"), "kind", "namespace", "line", F.lit("name").alias("match"))
    members = here(kb.members).filter(F.lit(True) if kind is None else F.col("symbolKind") == kind)
    match = F.when(has(F.col("name")), "member").when(has(F.col("signature")), "signature")
    members = members.select("relativePath", "at", "member_at", F.concat_ws(".", "symbol", "name").alias("symbol"), "kind", "namespace", "line", match.alias("match")).filter("match is not null")
    rows = symbols.unionByName(members).withColumn("file", F.col("relativePath"))
    return _cut(rows, (*_ORDER, "member_at"), limit, ("relativePath", "at", "member_at"))


def find(kb: KnowledgeBase, kind: str | None = None, namespace: str | None = None, base: str | None = None, has_attribute: str | None = None, has_member: str | None = None, is_unity_message: bool | None = None, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """(symbol, kind, namespace, file, line, bases, memberCount) of symbols that meet all criteria."""
    test = _prefix(F.col("namespace"), namespace)
    any_of = lambda items, f: F.coalesce(F.exists(items, f), F.lit(False))
    if kind:
        test = test & (F.col("kind") == kind)
    if base:
        test = test & any_of("bases", lambda b: F.contains(b, F.lit(base)))
    if has_attribute:
        test = test & any_of("attributes", lambda a: F.contains(a, F.lit(has_attribute)))
    if has_member:
        test = test & any_of("members", lambda m: F.contains(F.lower(m["name"]), F.lit(has_member.lower())))
    if is_unity_message is not None:  # the mark is set or absent, never false
        test = test & any_of("members", lambda m: F.coalesce(m["isUnityMessage"] == is_unity_message, F.lit(False)))
    count = F.coalesce(F.size("members"), F.lit(0))
    rows = kb.symbols.filter(test).select("relativePath", "at", F.col("name").alias("symbol"), "kind", "namespace", F.col("relativePath").alias("file"), "line", "bases", F.greatest(count, F.lit(0)).alias("memberCount"))
    return _cut(rows, _ORDER, limit, ("relativePath", "at"))


def implementations(kb: KnowledgeBase, base: str, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    return find(kb, base=base, limit=limit)


def export(kb: KnowledgeBase, namespace: str | None = None, file: str | None = None) -> DataFrame:
    """Symbols with their members and their file's dependencies."""
    files = kb.file_symbols if file is None else kb.file_symbols.filter(F.col("relativePath") == file)
    rows = files.select("relativePath", "dependencies", F.posexplode("symbols").alias("at", "s")).filter(_prefix(F.col("s.namespace"), namespace))
    return rows.select("relativePath", "at", "s.*", "dependencies").orderBy(*_ORDER).withColumnRenamed("relativePath", "file").drop("at")


def get_symbol(kb: KnowledgeBase, name: str, namespace: str | None = None) -> DataFrame:
    """The first symbol of exactly that name."""
    rows = kb.symbols.filter((F.col("name") == name) & _prefix(F.col("namespace"), namespace))
    return rows.orderBy(*_ORDER).limit(1).withColumnRenamed("relativePath", "file").drop("at")


def file_symbols(kb: KnowledgeBase, file: str) -> DataFrame:
    rows = kb.file_symbols.filter(F.col("relativePath") == file)
    if rows.isEmpty():
        raise FileNotFoundError(f"File not found: {file}")
    return rows


def namespace_counts(kb: KnowledgeBase, prefix: str | None = None) -> DataFrame:
    """(namespace, count), `(global)` for symbols without one."""
    rows = kb.symbols.filter(_prefix(F.col("namespace"), prefix))
    return rows.groupBy(F.coalesce("namespace", F.lit("(global)")).alias("namespace")).agg(F.count("*").alias("count"))


def stats(kb: KnowledgeBase, namespace: str | None = None, top: int = 10) -> dict:
    """Files, symbols, namespaces, and the namespaces with most symbols."""
    counts = namespace_counts(kb, namespace)
    best = [(r["namespace"], r["count"]) for r in counts.orderBy(F.desc("count"), "namespace").limit(top).collect()]
    n, symbols = counts.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    files = kb.symbols.filter(_prefix(F.col("namespace"), namespace)).agg(F.countDistinct("relativePath")).first()[0] if namespace else kb.file_symbols.count()
    if not namespace and kb.meta:
        files, symbols = kb.meta.get("fileCount", files), kb.meta.get("symbolCount", symbols)
    return {"files": files, "symbols": symbols, "namespaces": n, "topNamespaces": best}


def list_namespaces(kb: KnowledgeBase, prefix: str | None = None) -> DataFrame:
    return kb.symbols.filter(F.col("namespace").isNotNull() & _prefix(F.col("namespace"), prefix)).select("namespace").distinct().orderBy("namespace")


def namespace_summary(kb: KnowledgeBase, namespace: str) -> DataFrame:
    """Symbols of exactly that namespace."""
    rows = kb.symbols.filter(F.col("namespace") == namespace)
    return rows.orderBy(*_ORDER).select("name", "kind", F.col("relativePath").alias("file"), "line")
