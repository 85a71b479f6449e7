"""One-condition filters: parsing and compilation.

`path op literal` with >= <= != = > < contains startsWith endsWith, or
`path exists`. A row passes if any value at the path satisfies the condition, so
a path without values never does, not even for `!=`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

from tessella.functions import paths
from tessella.functions.paths import Values

#: Fixed order in which operators are looked for.
SYMBOLS = (">=", "<=", "!=", "=", ">", "<")
WORDS = ("contains", "startsWith", "endsWith")
_NUMBER = re.compile(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|0[xX][0-9a-fA-F]+)$")


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    path: str
    operator: str
    value: object = None
    side: str | None = None  # a, b: one side of a join


def literal(text: str) -> object:
    """Quoted text, true, false, null, a number, or bare text. Single quotes are ordinary characters."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] == '"':
        return text[1:-1]
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    if _NUMBER.match(text):
        if text.lower().startswith("0x"):
            return int(text, 16)
        return int(text) if text.lstrip("+-").isdigit() else float(text)
    return text


def _outside(text: str) -> str:
    """`text` with what stands in double quotes blanked, so that operators in it are not seen."""
    return re.sub(r'"[^"]*"', lambda m: "\0" * len(m[0]), text)


def parse_filter(text: str, sides: bool = False) -> Condition:
    """The condition that the text states; FilterError if it states none."""
    seen = _outside(text)
    found = None
    for symbol in SYMBOLS:
        at = seen.find(symbol, 1)
        if at > 0 and text[:at].strip() and text[at + len(symbol) :].strip():
            found = (text[:at].strip(), symbol, literal(text[at + len(symbol) :]))
            break
    if found is None:
        for word in WORDS:
            if (m := re.search(rf"\s{word}\s", seen, re.I)) and text[: m.start()].strip():
                found = (text[: m.start()].strip(), word, literal(text[m.end() :]))
                break
    if found is None and (m := re.match(r"^(.+?)\s+exists\s*$", text, re.I)):
        found = (m[1].strip(), "exists", None)
    if found is None:
        raise FilterError(f"not a filter: {text!r}")
    path, operator, value = found
    side = path[0] if sides and path[:2] in ("a.", "b.") else None
    return Condition(path[2:] if side else path, operator, value, side)


def conditions(filters: str | Condition | list | tuple | None, sides: bool = False) -> list[Condition]:
    """One filter, or several that all must hold."""
    if filters is None:
        return []
    many = filters if isinstance(filters, (list, tuple)) else [filters]
    return [f if isinstance(f, Condition) else parse_filter(f, sides) for f in many]


def _equals(v: Column, dtype: T.DataType, value: object) -> Column:
    """Type and value agree; false, not NULL, for other types."""
    if value is None:
        return paths.is_null(v, dtype)
    if isinstance(value, bool):
        return paths.as_flag(v, dtype) == value
    if isinstance(value, (int, float)):
        return F.coalesce(_numbers(v, dtype, "=", value), F.lit(False)) if isinstance(dtype, T.VariantType) else _numbers(v, dtype, "=", value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return v == F.lit(value).cast(dtype)
    return paths.as_text(v, dtype) == value


def _millis(value: object) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    try:
        when = datetime.fromisoformat(value if len(value) > 7 else value + "-01")
    except ValueError:
        return None
    return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp() * 1000


def _compare(a: Column, operator: str, b) -> Column:
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b, "=": a == b}[operator]


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _numbers(v: Column, dtype: T.DataType, operator: str, value: int | float) -> Column:
    """A number against a literal; integers, also beyond the exact range of doubles, are compared as such."""
    whole = value == value and abs(value) != float("inf") and value == int(value)
    fits = whole and _LEAST <= int(value) <= _MOST
    if isinstance(dtype, T.VariantType):
        own, other = paths.exact_integer(v, dtype), _compare(paths.as_number(v, dtype), operator, float(value))
        return F.when(own.isNotNull(), _compare(own, operator, int(value))).otherwise(other) if fits else other
    if isinstance(dtype, paths.INTEGERS):
        if fits:
            return _compare(v, operator, int(value))
        return F.lit(False) if operator == "=" else _compare(v.cast("double"), operator, float(value))
    if isinstance(dtype, T.DecimalType):
        bound = Decimal(int(value)) if whole else Decimal(repr(value))
        return _compare(v, operator, F.lit(bound) if abs(bound) < Decimal(10) ** 38 and -bound.as_tuple().exponent <= 38 else float(value))
    return _compare(v if isinstance(dtype, T.DoubleType) else paths.as_number(v, dtype), operator, float(value))


def _ordered(v: Column, dtype: T.DataType, operator: str, value: object, numbers_only: bool, truncate: bool) -> Column:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if number and (numbers_only or isinstance(dtype, paths._NUMBERS)):
        if truncate:
            return _compare(F.floor(v), operator, int(value))
        return _numbers(v, dtype, operator, value)
    if numbers_only:
        return F.lit(False)
    at = _millis(value)
    if at is None:
        return F.lit(False)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        bound = F.timestamp_millis(F.lit(int(at))) if number else F.lit(datetime.fromtimestamp(at / 1000, timezone.utc))
        return _compare(v, operator, bound.cast(dtype) if not isinstance(dtype, T.DateType) else bound)
    if number and isinstance(dtype, T.VariantType):
        own = _compare(F.floor(paths.as_number(v, dtype)), operator, int(value)) if truncate else _numbers(v, dtype, operator, value)
        return F.coalesce(own, _compare(paths.text_millis(paths.as_text(v, dtype)).cast("double"), operator, at))
    return _compare(paths.as_millis(v, dtype), operator, at)


def test_value(v: Column, dtype: T.DataType, c: Condition, numbers_only: bool = False, truncate: bool = False) -> Column:
    """Whether one value satisfies the condition."""
    if c.operator == "=":
        return _equals(v, dtype, c.value)
    if c.operator == "!=":
        if c.value is None:
            return ~paths.is_null(v, dtype)
        if isinstance(dtype, T.VariantType):
            return ~F.coalesce(_equals(v, dtype, c.value), F.lit(False))
        # a NULL of a typed row is an explicit null, which differs from any other value
        return v.isNull() | (v != c.value if _plain(dtype, c.value) else ~F.coalesce(_equals(v, dtype, c.value), F.lit(False)))
    if c.operator == "exists":
        return ~paths.is_null(v, dtype)
    if c.operator == "contains":
        text = paths.as_text(v, dtype).contains(c.value) if isinstance(c.value, str) else F.lit(False)
        items = paths.as_items(v, dtype)
        if items is None:
            return text
        inside = F.exists(items[0], lambda x: F.coalesce(_equals(x, items[1], c.value), F.lit(False)))
        return F.coalesce(text, F.lit(False)) | F.coalesce(inside, F.lit(False))
    if c.operator == "startsWith":
        return paths.as_text(v, dtype).startswith(c.value) if isinstance(c.value, str) else F.lit(False)
    if c.operator == "endsWith":
        return paths.as_text(v, dtype).endswith(c.value) if isinstance(c.value, str) else F.lit(False)
    return _ordered(v, dtype, c.operator, c.value, numbers_only, truncate)


def _plain(dtype: T.DataType, value: object) -> bool:
    """Whether `column != literal` already says it, so that the scan can take it."""
    return isinstance(dtype, T.StringType) and isinstance(value, str)


def compile_condition(values: Values, c: Condition, numbers_only: bool = False, truncate: bool = False) -> Column:
    """Whether any of a path's values satisfies the condition. A single typed value stays a bare predicate for the scan."""
    if values.single:
        return test_value(values.column, values.dtype, c, numbers_only, truncate)
    return F.exists(values.array(), lambda v: F.coalesce(test_value(v, values.dtype, c, numbers_only, truncate), F.lit(False)))
