"""The aggregate vocabulary over paths: COUNT, SUM, AVG, MIN, MAX, COUNT_IF and DN_RETENTION.

Each aggregate is a per-row fold over the path's values and a built-in aggregate
of the folds, so that Spark combines them before the shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from tessella.functions import paths
from tessella.functions.paths import Values

_AGGREGATE = re.compile(r"^\s*(COUNT_IF|COUNT|SUM|AVG|MIN|MAX|D(\d+)_RETENTION)\s*\(\s*(.*?)\s*\)\s*$", re.I)
DAY_MS = 86_400_000
#: Fields of a login record that may hold its time, the first that is set counts.
TIME_FIELDS = ("date", "timestamp", "time")


class AggregateError(ValueError):
    pass


@dataclass(frozen=True)
class Aggregate:
    alias: str
    function: str  # COUNT, SUM, AVG, MIN, MAX, COUNT_IF, RETENTION
    path: str
    days: int = 0


def parse_aggregate(alias: str, text: str) -> Aggregate | None:
    """`FUNC(path)`; None if it is not one."""
    m = _AGGREGATE.match(text)
    if not m or not m[3]:
        return None
    if m[2]:
        return Aggregate(alias, "RETENTION", m[3], int(m[2]))
    function = m[1].upper()
    return None if m[3] == "*" and function != "COUNT" else Aggregate(alias, function, m[3])


def parse_aggregates(named: dict[str, str], strict: bool = True) -> list[Aggregate]:
    """All aggregates; not strict: unreadable ones are left out, and it is an error if none is left."""
    found = {alias: parse_aggregate(alias, text) for alias, text in named.items()}
    if strict and (bad := [a for a, x in found.items() if x is None]):
        raise AggregateError(f"not an aggregate: {', '.join(f'{a}={named[a]}' for a in bad)}")
    out = [x for x in found.values() if x]
    if not out:
        raise AggregateError("no aggregate given")
    return out


def numbers(values: Values) -> Column:
    """All numbers at a path, as array<double>."""
    kept = F.transform(values.array(), lambda v: paths.as_number(v, values.dtype))
    return F.filter(kept, lambda x: x.isNotNull())


def is_truthy(v: Column, dtype: T.DataType) -> Column:
    return F.coalesce(paths.as_flag(v, dtype), paths.as_number(v, dtype) > 0, F.lit(False))


def moments(v: Column, dtype: T.DataType) -> Column:
    """Epoch milliseconds of a login: a time, or a record that holds one; 0 and unreadable ones give NULL."""
    own = paths.as_millis(v, dtype)
    if isinstance(dtype, T.VariantType):
        inner = [paths.as_millis(F.try_variant_get(v, f"$.{f}", "variant"), dtype) for f in TIME_FIELDS]
        own = F.coalesce(own, *[F.nullif(x, F.lit(0.0)) for x in inner])
    elif isinstance(dtype, T.StructType):
        inner = [paths.as_millis(v.getField(f), dtype[f].dataType) for f in TIME_FIELDS if f in dtype.fieldNames()]
        own = F.coalesce(*inner) if inner else F.lit(None).cast("double")
    return F.nullif(own, F.lit(0.0))


def retained(values: Values, days: int) -> Column:
    """Whether the array at the path has two times at least `days` days apart; the path must name the array itself."""
    first = values.first()
    items = paths.as_items(first, values.dtype)
    if items is None:
        return F.lit(False)
    times = F.filter(F.transform(F.coalesce(items[0], F.array().cast(T.ArrayType(items[1]))), lambda v: moments(v, items[1])), lambda x: x.isNotNull())
    return F.coalesce(F.array_max(times) - F.array_min(times) >= days * DAY_MS, F.lit(False)) & (F.size(times) >= 2)


def compile_aggregate(a: Aggregate, values: Values | None) -> Column:
    """The aggregate as a column for `agg`, named by its alias; empty inputs give 0."""
    if a.function == "COUNT":
        out = F.count("*") if a.path == "*" or values is None else F.count_if(~F.coalesce(paths.is_null(values.first(), values.dtype), F.lit(True)))
    elif a.function == "COUNT_IF":
        out = F.coalesce(F.sum(F.size(F.filter(values.array(), lambda v: is_truthy(v, values.dtype)))), F.lit(0)).cast("bigint")
    elif a.function == "RETENTION":
        out = F.count_if(retained(values, a.days))
    elif values.single and isinstance(values.dtype, paths._NUMBERS):
        plain = values.column.cast("double")
        out = F.coalesce({"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[a.function](plain), F.lit(0.0))
    else:
        found = numbers(values)
        total = F.sum(F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x))
        out = {
            "SUM": lambda: total,
            "AVG": lambda: F.try_divide(total, F.sum(F.size(found))),
            "MIN": lambda: F.min(F.array_min(found)),
            "MAX": lambda: F.max(F.array_max(found)),
        }[a.function]()
        out = F.coalesce(out, F.lit(0.0))
    return out.alias(a.alias)


def totals_columns(aggregates: list[Aggregate]) -> list[Column]:
    """Totals over finished groups: the unweighted mean of averages, least and greatest of MIN and MAX, sums of all others."""
    kinds = {"AVG": F.avg, "MIN": F.min, "MAX": F.max}
    return [F.coalesce(kinds.get(a.function, F.sum)(a.alias), F.lit(0)).alias(a.alias) for a in aggregates]
