"""A collection of rows that can be queried by paths."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessella.functions import filters, paths
from tessella.functions.aggregates import numbers
from tessella.functions.filters import Condition
from tessella.functions.paths import TypedBackend, Values, VariantBackend
from tessella.sources import json_files

Filter = str | Condition | list | None
DEFAULT_LIMIT = 100


@dataclass
class QueryResult:
    """Rows of a query, lazy, and its exact counts, made by one aggregate when first asked for."""

    rows: DataFrame
    _counts: DataFrame
    _found: tuple[int, int] | None = field(default=None, repr=False)

    def _count(self) -> tuple[int, int]:
        if self._found is None:
            self._found = tuple(self._counts.first())
        return self._found

    @property
    def total_matched(self) -> int:
        return self._count()[0]

    @property
    def total_scanned(self) -> int:
        return self._count()[1]


class Dataset:
    """Rows with a path backend.

    `order` are columns that give the rows their order; without any, a query with
    a limit returns some rows, as Spark does.
    """

    def __init__(self, df: DataFrame, backend, order: list[str] | None = None):
        self.df, self.backend, self.order = df, backend, order or []

    @classmethod
    def table(cls, df: DataFrame, order: list[str] | None = None) -> Dataset:
        """Rows with a schema."""
        return cls(df, TypedBackend(df.schema), order)

    @classmethod
    def variants(cls, df: DataFrame, column: str = "entity", order: list[str] | None = None) -> Dataset:
        """Rows of dynamic JSON in a VARIANT column."""
        return cls(df, VariantBackend(column), order if order is not None else (["pos"] if "pos" in df.columns else []))

    @classmethod
    def json(cls, spark: SparkSession, path: str, root: str = "entities") -> Dataset:
        return cls.variants(json_files.read_entities(spark, json_files.validate_file(spark, path), root))

    @classmethod
    def json_text(cls, df: DataFrame, column: str, order: list[str] | None = None) -> Dataset:
        """JSON in a text column; unreadable text has no values."""
        return cls.variants(df.withColumn(column, F.try_parse_json(column)), column, order)

    def values(self, path: str) -> Values:
        return self.backend.values(path)

    def cache(self) -> Dataset:
        """Keep the rows, so that several questions to one JSON file parse it once."""
        return type(self)(self.df.cache(), self.backend, self.order)

    # filters -------------------------------------------------------------------------------------

    def predicate(self, filter: Filter, truncate: bool = False) -> Column | None:
        out = None
        for c in filters.conditions(filter):
            own = filters.compile_condition(self.values(c.path), c, truncate=truncate)
            out = own if out is None else out & own
        return out

    def where(self, filter: Filter, truncate: bool = False) -> Dataset:
        test = self.predicate(filter, truncate)
        return self if test is None else type(self)(self.df.filter(test), self.backend, self.order)

    # queries -------------------------------------------------------------------------------------

    def project(self, path: str) -> Column:
        """First value at a path, or with `.length` the length of the array there."""
        if path.endswith(".length"):
            base = self.values(path[: -len(".length")])
            items = paths.as_items(base.first(), base.dtype)
            if items is not None:
                size = F.when(items[0].isNotNull(), F.size(items[0]))
                return F.coalesce(size.cast("variant"), base.first()) if isinstance(base.dtype, T.VariantType) else size
            return base.first()
        return self.values(path).first()

    def selected(self, select: list[str] | None) -> list[Column]:
        if not select:
            return [F.col(c) for c in self.df.columns if c not in self.order] if isinstance(self.backend, VariantBackend) else [F.col(c) for c in self.df.columns]
        names: dict[str, str] = {}
        for path in select:
            names[paths.last_segment(path)] = path  # a later path of that name replaces an earlier one
        return [self.project(path).alias(name) for name, path in names.items()]

    def query(self, select: list[str] | None = None, filter: Filter = None, limit: int | None = DEFAULT_LIMIT, offset: int = 0, order_by: list | None = None, truncate: bool = False) -> QueryResult:
        """Matching rows from `offset` on, at most `limit`, in row order or by order_by; counts cover all rows."""
        test = self.predicate(filter, truncate)
        rows = self.df if test is None else self.df.filter(test)
        order = order_by or [F.col(c) for c in self.order]
        if order and (limit is not None or offset):
            rows = rows.orderBy(*order)
        rows = rows.offset(offset) if offset else rows
        rows = rows.limit(limit) if limit is not None else rows
        matched = F.count("*") if test is None else F.count_if(test)
        return QueryResult(rows.select(*self.selected(select)), self.df.agg(matched.alias("matched"), F.count("*").alias("scanned")))

    def count(self, filter: Filter = None) -> DataFrame:
        """One row: total, scanned."""
        test = self.predicate(filter)
        return self.df.agg((F.count("*") if test is None else F.count_if(test)).alias("total"), F.count("*").alias("scanned"))

    def exploded(self, path: str, filter: Filter = None) -> tuple[DataFrame, T.DataType]:
        """(value): a row for each value at the path."""
        rows, values = self.where(filter).df, self.values(path)
        return (rows.select(values.column.alias("value")) if values.single else rows.select(F.explode(values.array()).alias("value"))), values.dtype

    def group_by(self, path: str, filter: Filter = None, sort: str | None = "count") -> DataFrame:
        """(key, count) of the values at a path; sort: count (descending, ties by key), key, or None."""
        rows, dtype = self.exploded(path, filter)
        out = rows.groupBy(paths.key_text(F.col("value"), dtype).alias("key")).agg(F.count("*").alias("count"))
        return {"count": lambda: out.orderBy(F.desc("count"), "key"), "key": lambda: out.orderBy("key"), None: lambda: out}[sort]()

    def group_summary(self, path: str, filter: Filter = None) -> DataFrame:
        """One row: total values, unique values, scanned rows."""
        keys = self.group_by(path, filter, None).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count("*").alias("unique_values"))
        return keys.crossJoin(F.broadcast(self.df.agg(F.count("*").alias("scanned"))))  # one row each

    def _numbers(self, path: str, filter: Filter) -> DataFrame:
        values = self.values(path)
        rows = self.where(filter).df
        if values.single:
            return rows.select(paths.as_number(values.column, values.dtype).alias("x")).filter("x is not null")
        return rows.select(F.explode(numbers(values)).alias("x"))

    def stats(self, path: str, filter: Filter = None) -> DataFrame:
        """One row: count, sum, avg, min, max of the numbers at a path; all 0 if there are none."""
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return self._numbers(path, filter).agg(
            F.count("x").alias("count"), zero(F.sum("x")).alias("sum"), zero(F.avg("x")).alias("avg"), zero(F.min("x")).alias("min"), zero(F.max("x")).alias("max")
        )

    def distribution(self, path: str, buckets: int = 10, filter: Filter = None) -> DataFrame:
        """(bucket, low, high, label, count, percentage) of an equal-width histogram; empty buckets are rows too."""
        found = self._numbers(path, filter)
        limits = found.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count("x").alias("n")).filter("n > 0")
        limits = limits.withColumn("width", F.coalesce(F.nullif((F.col("most") - F.col("least")) / buckets, F.lit(0.0)), F.lit(1.0)))
        at = F.least(F.floor((F.col("x") - F.col("least")) / F.col("width")), F.lit(buckets - 1)).cast("int")
        counts = found.crossJoin(F.broadcast(limits)).groupBy(at.alias("bucket")).agg(F.count("*").alias("count"))  # limits: one row
        frame = self.df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).crossJoin(F.broadcast(limits))
        low, high = F.col("least") + F.col("bucket") * F.col("width"), F.col("least") + (F.col("bucket") + 1) * F.col("width")
        count = F.coalesce("count", F.lit(0))
        return frame.join(counts, "bucket", "left").select(
            "bucket",
            low.alias("low"),
            high.alias("high"),
            F.format_string("%.1f-%.1f", low, high).alias("label"),
            count.alias("count"),
            (count / F.col("n") * 100).alias("percentage"),
        )

    def sample(self, k: int = 3, path: str | None = None, entity_type: str | None = None, seed: int = 0) -> DataFrame:
        """k rows drawn uniformly by a seeded hash; the same seed draws the same rows. In `path` a wildcard stands for elements of arrays alone."""
        rows = self if entity_type is None else type(self)(self.df.filter(self.is_type(entity_type)), self.backend, self.order)
        key = F.xxhash64(*[F.col(c) for c in self.order], F.lit(seed)) if self.order else F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.df.columns])), F.lit(seed))
        picked = rows.df.orderBy(key).limit(k)
        if path is None:
            return picked.select(*rows.selected(None))
        values = rows.backend.values(path, arrays_only=True)
        kept = values.array()
        if values.single:
            return picked.select(values.column.alias("value"))
        only = F.get(kept, F.lit(0))
        nested = isinstance(values.dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        return picked.select(F.when(F.size(kept) == 1, F.to_json(only) if nested else only.cast("string")).otherwise(F.to_json(kept)).alias("value"))

    def is_type(self, name: str) -> Column:
        """Whether entityId starts with `name:`, or, where that is no text, $type contains the name."""
        own, kind = self.values("entityId"), self.values("$type")
        text, type_text = paths.as_text(own.first(), own.dtype), paths.as_text(kind.first(), kind.dtype)
        return F.coalesce(F.when(text.isNotNull(), text.startswith(name + ":")).otherwise(type_text.contains(name)), F.lit(False))

    # schema, ids: see tessella.plans.discovery ---------------------------------------------------

    def schema(self, max_depth: int = 10):
        from tessella.plans import discovery

        return discovery.infer_schema(self, max_depth=max_depth)

    def join(self, other: Dataset, **options):
        from tessella.operators import joins

        return joins.join(self, other, **options)

    def aggregate_join(self, other: Dataset, **options):
        from tessella.operators import joins

        return joins.aggregate_join(self, other, **options)
