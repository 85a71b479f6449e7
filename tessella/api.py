"""Named tools with plain arguments and JSON results, the surface behind the command line and the HTTP server."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from tessella.functions.keeping import kept, letting_go
from tessella.operators.dataset import Dataset
from tessella.plans import discovery, reports
from tessella.plans.render import plain, schema_yaml, truncated
from tessella.sources.json_files import read_values, validate_file
from tessella.symbols import graph, ranking, search
from tessella.symbols.store import KnowledgeBase, index_project, list_projects


def data_dir() -> str:
    return os.environ.get("TESSELLA_DATA_DIR", "data")


class Tools:
    """Every tool is a method; `call` runs one by name and reports errors as a value."""

    #: Rows that a tool returns unless told otherwise.
    LIMIT, SYMBOL_LIMIT = 100, 20

    def __init__(self, spark: SparkSession, knowledge_dir: str | None = None):
        self.spark, self.knowledge_dir = spark, knowledge_dir or data_dir()

    def names(self) -> list[str]:
        return sorted(n for n in dir(self) if n[0] != "_" and n not in ("call", "names", "spark", "knowledge_dir", "LIMIT", "SYMBOL_LIMIT"))

    def call(self, tool: str, /, **arguments) -> dict:
        if tool not in self.names():
            return {"error": f"Unknown tool: {tool}"}
        try:
            with letting_go():
                return {"result": getattr(self, tool)(**arguments)}
        except Exception as e:  # a tool's failure is its answer
            return {"error": str(e).splitlines()[0] if str(e) else type(e).__name__}

    # JSON files -----------------------------------------------------------------------------------

    def _open(self, file: str, root: str = "entities") -> Dataset:
        return Dataset.json(self.spark, file, root)

    def get_schema(self, file: str, max_depth: int = 10, max_examples: int = 3, patterns: bool = True, format: str = "yaml"):
        node = discovery.infer_schema(self._open(file), max_depth, max_examples, patterns)
        return schema_yaml(node) if format == "yaml" else node.to_json()

    def sample_data(self, file: str, count: int = 3, path: str | None = None, entity_type: str | None = None, seed: int = 0, max_text: int = 100, max_depth: int = 5):
        data = self._open(file)
        path = path.removeprefix("entities[*].") if path and path != "entities" else None
        return [truncated(plain(r[0]), max_text, max_depth) for r in data.sample(count, path, entity_type, seed).collect()]

    def sample_root(self, file: str, count: int = 3, seed: int = 0):
        """Rows of a file whose document is an array itself."""
        data = Dataset.variants(read_values(self.spark, validate_file(self.spark, file)))
        return [plain(r[0]) for r in data.sample(count, seed=seed).collect()]

    def query_json(self, file: str, select: list[str] | None = None, filter=None, limit: int = LIMIT, offset: int = 0):
        data = self._open(file).cache()
        found = data.query(select, filter, limit, offset)
        out = {"rows": [plain(r) for r in found.rows.collect()], "totalMatched": found.total_matched, "totalScanned": found.total_scanned}
        data.df.unpersist()
        return out

    def count_entities(self, file: str, filter=None):
        return plain(self._open(file).count(filter).first())

    def group_by(self, file: str, path: str, filter=None, sort: str = "count", limit: int | None = None):
        data = self._open(file).cache()
        rows = data.group_by(path, filter, sort)
        out = {"groups": [plain(r) for r in (rows if limit is None else rows.limit(limit)).collect()]} | plain(data.group_summary(path, filter).first())
        data.df.unpersist()
        return out

    def get_stats(self, file: str, path: str, filter=None):
        return plain(self._open(file).stats(path, filter).first())

    def distribution(self, file: str, path: str, buckets: int = 10, filter=None):
        data = self._open(file).cache()
        out = [plain(r) for r in data.distribution(path, buckets, filter).orderBy("bucket").collect()]
        data.df.unpersist()
        return out

    def find_relationships(self, left: str, right: str, min_coverage: float = 50):
        return [plain(r) for r in discovery.find_relationships(self._open(left), self._open(right), min_coverage).collect()]

    def join_files(self, left: str, right: str, left_key: str | None = None, right_key: str | None = None, select: list[str] | None = None, filter=None, limit: int = LIMIT, group_by: str | None = None, aggregate: dict[str, str] | None = None):
        a, b = self._open(left).cache(), self._open(right).cache()
        try:
            if group_by and aggregate:
                groups, totals = a.aggregate_join(b, group_by=group_by, aggregate=aggregate, left_key=left_key, right_key=right_key, filter=filter)
                return {"groups": [plain(r) for r in groups.orderBy("key").collect()], "totals": plain(totals.first())}
            found = a.join(b, left_key=left_key, right_key=right_key, select=select, filter=filter, limit=limit)
            return {"rows": [plain(r) for r in found.rows.collect()], "totalMatched": found.total_matched(), "leftKey": found.left_key, "rightKey": found.right_key}
        finally:
            a.df.unpersist()
            b.df.unpersist()

    def run_report(self, directory: str, report: str):
        return plain(reports.run_report(self.spark, directory, report))

    def average_level(self, directory: str, field: str = "itemLevel"):
        return reports.average_level(self.spark, directory, field)

    def describe_dataset(self, directory: str, min_coverage: float = 50):
        d = discovery.describe_dataset(self.spark, directory, min_coverage)
        return {"directory": d.directory, "files": [vars(f) for f in d.files], "relationships": [plain(r) for r in d.relationships], "suggestedQueries": d.suggested_queries}

    # Symbols --------------------------------------------------------------------------------------

    def _kb(self, project: str) -> KnowledgeBase:
        return KnowledgeBase.open(self.spark, self.knowledge_dir, project)

    def _kept(self, project: str) -> KnowledgeBase:
        """With its file table cached while the tool runs."""
        kb = self._kb(project)
        kb.file_symbols = kept(kb.file_symbols)
        return kb

    def index_project(self, path: str, name: str, exclude: list[str] | None = None):
        return index_project(self.spark, path, name, self.knowledge_dir, exclude).meta

    def list_projects(self):
        return [KnowledgeBase.open(self.spark, self.knowledge_dir, n).meta for n in list_projects(self.spark, self.knowledge_dir)]

    def search_symbols(self, project: str, query: str, kind: str | None = None, namespace: str | None = None, path: str | None = None, limit: int = SYMBOL_LIMIT):
        rows = search.search(self._kb(project), query, kind, namespace, path, limit=None)
        return {"results": [plain(r) for r in rows.limit(limit).collect()], "total": rows.count()}

    def find_symbols(self, project: str, limit: int = SYMBOL_LIMIT, **criteria):
        rows = search.find(self._kb(project), limit=None, **criteria)
        return {"results": [plain(r) for r in rows.limit(limit).collect()], "total": rows.count()}

    def get_symbol(self, project: str, name: str, namespace: str | None = None):
        found = search.get_symbol(self._kb(project), name, namespace).first()
        if found is None:
            raise LookupError(f"Symbol not found: {name}")
        return plain(found)

    def get_dependencies(self, project: str, symbol: str, direction: str = "both", depth: int = 1):
        found = graph.dependencies(self._kept(project), symbol, direction, depth)
        if found is None:
            raise LookupError(f"Symbol not found: {symbol}")
        return found

    def get_file_symbols(self, project: str, file: str):
        return plain(search.file_symbols(self._kb(project), file).first())

    def find_relevant_files(self, project: str, task: str, max_files: int = 10, exclude: list[str] | None = None):
        return ranking.context(self._kept(project), task, max_files, exclude)

    def get_namespace_summary(self, project: str, namespace: str):
        return [plain(r) for r in search.namespace_summary(self._kb(project), namespace).collect()]

    def list_namespaces(self, project: str, prefix: str | None = None):
        return [r[0] for r in search.list_namespaces(self._kb(project), prefix).collect()]

    def get_implementations(self, project: str, base: str):
        return [plain(r) for r in search.implementations(self._kb(project), base).collect()]

    def symbol_stats(self, project: str, namespace: str | None = None):
        return search.stats(self._kb(project), namespace)

    def export_symbols(self, project: str, namespace: str | None = None, file: str | None = None):
        return [plain(r) for r in search.export(self._kb(project), namespace, file).collect()]

    def resolve_type(self, project: str, type_name: str, dependencies: bool = False):
        found = graph.resolve_type(self._kept(project), type_name, dependencies)
        if found is None:
            raise LookupError(f"Type not found: {type_name}")
        return plain(found)

    def ask(self, project: str, question: str):
        return plain(ranking.ask(self._kept(project), question))
