"""Key joins of two datasets, with key detection and grouped aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessella.functions import filters, paths
from tessella.functions.aggregates import Aggregate, compile_aggregate, parse_aggregates, totals_columns
from tessella.functions.paths import TypedBackend, Values, VariantBackend
from tessella.operators.dataset import DEFAULT_LIMIT, Dataset, Filter

#: Least coverage of a relationship that stands in for missing keys.
AUTO_COVERAGE = 30


class JoinError(ValueError):
    pass


@dataclass
class JoinResult:
    rows: DataFrame
    joined: DataFrame
    left_key: str
    right_key: str

    def total_matched(self) -> int:
        return self.joined.count()


def detect_keys(left: Dataset, right: Dataset, min_coverage: float = AUTO_COVERAGE) -> tuple[str, str]:
    """Key paths of the relationship that covers most of the left ids."""
    from tessella.plans import discovery

    best = discovery.find_relationships(left, right, min_coverage).limit(1).collect()
    if not best:
        raise JoinError("no common key was found; name left_key and right_key")
    return best[0]["left_path"], best[0]["right_path"]


class _Sides:
    """Paths into the two structs `a` and `b` of joined rows."""

    def __init__(self, left: Dataset, right: Dataset):
        self.by = {"a": self._inside("a", left), "b": self._inside("b", right)}

    @staticmethod
    def _inside(side: str, data: Dataset):
        if isinstance(data.backend, VariantBackend):
            return VariantBackend(f"{side}.{data.backend.column}")
        return TypedBackend(data.df.schema, side)

    def split(self, path: str) -> tuple[str | None, str]:
        return (path[0], path[2:]) if path[:2] in ("a.", "b.") else (None, path)

    def values(self, path: str) -> Values:
        side, rest = self.split(path)
        return self.by[side or "a"].values(rest)

    def test(self, c: filters.Condition) -> Column:
        """A condition without a side holds if either side has such a value; numbers alone are ordered."""
        sides = [c.side] if c.side else ["a", "b"]
        out = None
        for s in sides:
            own = F.coalesce(filters.compile_condition(self.by[s].values(c.path), c, numbers_only=True), F.lit(False))
            out = own if out is None else out | own
        return out

    def project(self, path: str) -> Column:
        if path.endswith(".length"):
            base = self.values(path[: -len(".length")])
            items = paths.as_items(base.first(), base.dtype)
            return F.coalesce(F.when(items[0].isNotNull(), F.size(items[0])), F.lit(0)) if items is not None else F.lit(0)
        return self.values(path).first()


def joined_rows(left: Dataset, right: Dataset, left_key: str, right_key: str, filter: Filter = None, how: str = "inner", explode_right: bool = False) -> tuple[DataFrame, _Sides]:
    """Rows (a, b): every left key value meets the first key value of right rows, as text (integers of one type as such); null and missing keys never meet."""
    lv, rv = left.values(left_key), right.values(right_key)

    # equal integer types are compared as such: narrower than text, and pruned by buckets and ranges
    native = lv.single and rv.single and lv.dtype == rv.dtype and isinstance(lv.dtype, paths.INTEGERS)

    def keyed(data: Dataset, values: Values, name: str, all_values: bool) -> DataFrame:
        real = lambda v: ~F.coalesce(paths.is_null(v, values.dtype), F.lit(True))
        row = F.struct("*").alias(name)
        if values.single or not all_values:
            first = values.first()
            key = first if native else F.when(real(first), paths.key_text(first, values.dtype))
            rows = data.df.select(row, key.alias("key"))
            return rows.filter("key is not null") if how == "inner" else rows
        keys = F.transform(F.filter(values.array(), real), lambda v: paths.key_text(v, values.dtype))
        return data.df.select(row, (F.explode if how == "inner" else F.explode_outer)(keys).alias("key"))

    out = keyed(left, lv, "a", True).join(keyed(right, rv, "b", explode_right), "key", how)
    sides = _Sides(left, right)
    for c in filters.conditions(filter, sides=True):
        out = out.filter(sides.test(c))
    return out, sides


def join(left: Dataset, right: Dataset, left_key: str | None = None, right_key: str | None = None, select: list[str] | None = None, filter: Filter = None, limit: int | None = DEFAULT_LIMIT, how: str = "inner", explode_right: bool = False) -> JoinResult:
    """Joined rows, at most `limit`, in left order; without select the two rows as structs left and right."""
    if not (left_key and right_key):
        left_key, right_key = detect_keys(left, right)
    rows, sides = joined_rows(left, right, left_key, right_key, filter, how, explode_right)
    if limit is not None:
        order = [F.col(f"a.`{c}`") for c in left.order] + [F.col(f"b.`{c}`") for c in right.order]
        rows_out = (rows.orderBy(*order) if order else rows).limit(limit)
    else:
        rows_out = rows
    if select:
        columns, used = [], set()
        for path in select:
            name = paths.last_segment(path)
            name = name if name not in used else f"{name}_{sides.split(path)[0] or 'a'}"
            used.add(name)
            columns.append(sides.project(path).alias(name))
        rows_out = rows_out.select(*columns)
    else:
        rows_out = rows_out.select(F.col("a").alias("left"), F.col("b").alias("right"))
    return JoinResult(rows_out, rows, left_key, right_key)


def _group_text(values: Values) -> Column:
    """First value as text; missing is `undefined`, null is `null`."""
    first = values.first()
    if values.single and not isinstance(values.dtype, T.VariantType):
        return paths.key_text(first, values.dtype)
    return F.when(F.size(values.array()) == 0, "undefined").otherwise(paths.key_text(first, values.dtype))


def aggregate_join(left: Dataset, right: Dataset, group_by: str | list[str], aggregate: dict[str, str], left_key: str | None = None, right_key: str | None = None, filter: Filter = None, how: str = "inner") -> tuple[DataFrame, DataFrame]:
    """(groups, totals) of the joined rows. Groups have the key (`key`, or a column per path) and the aggregates."""
    parsed: list[Aggregate] = parse_aggregates(aggregate)
    if not group_by:
        raise JoinError("group_by is needed")
    if not (left_key and right_key):
        left_key, right_key = detect_keys(left, right)
    rows, sides = joined_rows(left, right, left_key, right_key, filter, how)
    many = [group_by] if isinstance(group_by, str) else list(group_by)
    keys = [_group_text(sides.values(p)).alias("key" if len(many) == 1 else paths.last_segment(p)) for p in many]
    groups = rows.groupBy(*keys).agg(*[compile_aggregate(a, None if a.path == "*" else sides.values(a.path)) for a in parsed])
    return groups, groups.agg(*totals_columns(parsed))
