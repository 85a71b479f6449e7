"""Paths into nested rows, compiled to columns.

A path is keys, `[*]` and `[n]`: `payload.items[*].id`. It may have any number of
values in one row. Two backends compile it with the same meaning:

* typed: the input has a schema. A path through structs stays one plain column,
  so filters reach the scan and nested columns are pruned; only wildcards and
  arrays make it an array expression.
* variant: rows are dynamic JSON in a VARIANT column; every path is an array of
  variants.

A missing key and an explicit null differ in the variant backend. A typed column
knows only NULL, which counts as an explicit null where it is a value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

VARIANT = T.VariantType()


@dataclass(frozen=True)
class Segment:
    kind: str  # key, all, index
    value: str = ""


def _bracketed(text: str) -> Segment:
    if text == "*":
        return Segment("all")
    return Segment("index" if text.isascii() and text.isdigit() else "key", text)


def parse_path(path: str) -> list[Segment]:
    """Segments of a path. A bare `*` is a key, `[abc]` is the key abc, dots and brackets without content say nothing."""
    out: list[Segment] = []
    for piece in path.split("."):
        name, *rest = piece.replace("]", "[").split("[")
        # what is outside brackets stands at even places, what is inside at odd ones
        inside = [False] + [i % 2 == 0 for i in range(len(rest))] if "[" in piece else [False] * (1 + len(rest))
        out += [_bracketed(part) if within else Segment("key", part) for part, within in zip([name, *rest], inside, strict=True) if part]
    return out


def last_segment(path: str) -> str:
    """Name that a selected path gets: its last part between dots, brackets included."""
    return path.rsplit(".", 1)[-1]


@dataclass
class Values:
    """What a path yields in one row: a column of `dtype` if single, else an array of it."""

    column: Column
    dtype: T.DataType
    single: bool

    def array(self) -> Column:
        """All values as an array; a NULL single value is an explicit null of a typed row."""
        return F.array(self.column) if self.single else F.coalesce(self.column, F.array().cast(T.ArrayType(self.dtype)))

    def first(self) -> Column:
        return self.column if self.single else F.get(self.column, F.lit(0))

    def exists(self, test) -> Column:
        """Whether any value passes."""
        found = test(self.column) if self.single else F.exists(self.array(), test)
        return F.coalesce(found, F.lit(False))


class TypedBackend:
    """Paths over the columns of a DataFrame with a schema."""

    def __init__(self, schema: T.StructType, prefix: str | None = None):
        self.schema, self.prefix = schema, prefix

    def values(self, path: str, arrays_only: bool = False) -> Values:
        """With arrays_only a wildcard stands for the elements of arrays alone, not for the values of objects."""
        column, dtype, many = None, self.schema, False
        for seg in parse_path(path):
            off = arrays_only and seg.kind == "all" and not isinstance(dtype, (T.ArrayType, T.VariantType))
            step = None if off else self._step(column, dtype, many, seg, arrays_only)
            if step is None:
                return Values(F.array().cast("array<string>"), T.StringType(), False)
            column, dtype, many = step
        if column is None:
            column = F.struct(*[self._root(f.name) for f in self.schema.fields])
        return Values(column, dtype, not many)

    def _root(self, name: str) -> Column:
        quoted = f"`{name}`"
        return F.col(f"{self.prefix}.{quoted}" if self.prefix else quoted)

    def _step(self, column: Column | None, dtype: T.DataType, many: bool, seg: Segment, arrays_only: bool = False):
        if column is None:
            if seg.kind == "key" and seg.value in self.schema.fieldNames():
                return self._root(seg.value), self.schema[seg.value].dataType, False
            if seg.kind == "all":
                column = F.struct(*[self._root(f.name) for f in self.schema.fields])
            else:
                return None
        found = self._inside(dtype, seg, arrays_only)
        if found is None:
            return None
        get, out, spreads = found
        if not many:
            return (get(column), out, spreads)
        # a null on the way has nothing below it; a null at the end is kept
        mapped = F.transform(F.filter(column, lambda x: x.isNotNull()), get)
        return (F.flatten(F.filter(mapped, lambda x: x.isNotNull())) if spreads else mapped, out, True)

    def _inside(self, dtype: T.DataType, seg: Segment, arrays_only: bool = False):
        """(column -> column, type, whether the result is an array of values)."""
        if isinstance(dtype, T.StructType):
            if seg.kind == "key" and seg.value in dtype.fieldNames():
                return (lambda x: x.getField(seg.value)), dtype[seg.value].dataType, False
            if seg.kind == "all" and dtype.fields:
                kinds = {f.dataType.simpleString() for f in dtype.fields}
                names = dtype.fieldNames()
                if len(kinds) == 1:
                    return (lambda x: F.array(*[x.getField(n) for n in names])), dtype.fields[0].dataType, True
                return (lambda x: F.array(*[x.getField(n).cast("string") for n in names])), T.StringType(), True
        elif isinstance(dtype, T.MapType):
            if seg.kind == "key":
                return (lambda x: F.try_element_at(x, F.lit(seg.value))), dtype.valueType, False
            if seg.kind == "all":
                return F.map_values, dtype.valueType, True
        elif isinstance(dtype, T.ArrayType):
            if seg.kind == "all":
                return (lambda x: x), dtype.elementType, True
            if seg.kind == "key" and seg.value == "length":
                return F.size, T.IntegerType(), False
            if seg.kind == "index" or seg.value.isdigit():
                return (lambda x: F.get(x, F.lit(int(seg.value)))), dtype.elementType, False
        elif isinstance(dtype, T.VariantType):
            step = _variant_step(seg, arrays_only)
            return (lambda x: step(F.array(x))), VARIANT, True
        return None


def _variant_step(seg: Segment, arrays_only: bool = False):
    """array<variant> -> array<variant>."""
    as_array = lambda x: F.try_variant_get(x, "$", "array<variant>")
    if seg.kind == "all":
        as_map = lambda x: F.map_values(F.try_variant_get(x, "$", "map<string,variant>"))
        forms = [as_array] if arrays_only else [as_array, as_map]
        return lambda cur: F.flatten(F.transform(cur, lambda x: F.coalesce(*[f(x) for f in forms], F.array().cast("array<variant>"))))
    if seg.kind == "index":
        get = lambda x: F.try_variant_get(x, f"$[{seg.value}]", "variant")
    else:
        quoted = seg.value.replace("\\", "\\\\").replace('"', '\\"')
        own = lambda x: F.try_variant_get(x, f'$["{quoted}"]', "variant")
        if seg.value == "length":
            get = lambda x: F.coalesce(own(x), F.size(as_array(x)).cast("variant"))
        elif seg.value.isdigit():
            get = lambda x: F.coalesce(own(x), F.try_variant_get(x, f"$[{seg.value}]", "variant"))
        else:
            get = own
    return lambda cur: F.filter(F.transform(cur, get), lambda x: x.isNotNull())


class VariantBackend:
    """Paths into one VARIANT column."""

    def __init__(self, column: str = "entity"):
        self.column = column

    def values(self, path: str, arrays_only: bool = False) -> Values:
        current = F.filter(F.array(F.col(self.column)), lambda x: x.isNotNull())
        for seg in parse_path(path):
            current = _variant_step(seg, arrays_only)(current)
        return Values(current, VARIANT, False)


# Facts about one value, the same for both backends ------------------------------------------------

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)


def _tag(v: Column, tag: Column | None = None) -> Column:
    """The type of a variant; `tag` if a caller has it already."""
    return F.schema_of_variant(v) if tag is None else tag


def is_null(v: Column, dtype: T.DataType) -> Column:
    return v.isNull() | F.is_variant_null(v) if isinstance(dtype, T.VariantType) else v.isNull()


def as_number(v: Column, dtype: T.DataType, tag: Column | None = None) -> Column:
    """The value as DOUBLE if it is a number, else NULL; text is never read as a number."""
    if isinstance(dtype, T.VariantType):
        return F.when(_tag(v, tag).rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
    return v.cast("double") if isinstance(dtype, _NUMBERS) else F.lit(None).cast("double")


def as_text(v: Column, dtype: T.DataType, tag: Column | None = None) -> Column:
    """The value if it is text, else NULL."""
    if isinstance(dtype, T.VariantType):
        return F.when(_tag(v, tag) == "STRING", F.try_variant_get(v, "$", "string"))
    return v if isinstance(dtype, T.StringType) else F.lit(None).cast("string")


def as_flag(v: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        return F.when(_tag(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    return v if isinstance(dtype, T.BooleanType) else F.lit(None).cast("boolean")


def as_items(v: Column, dtype: T.DataType) -> tuple[Column, T.DataType] | None:
    """The elements if the value is an array, and their type; None if it can't be one."""
    if isinstance(dtype, T.VariantType):
        return F.try_variant_get(v, "$", "array<variant>"), VARIANT
    return (v, dtype.elementType) if isinstance(dtype, T.ArrayType) else None


_ISO = r"^\d{4}-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?)?$"


def text_millis(text: Column) -> Column:
    """Epoch milliseconds of ISO-8601 text, else NULL."""
    full = F.when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)
    return F.when(text.rlike(_ISO), F.unix_millis(F.try_to_timestamp(full)))


def as_millis(v: Column, dtype: T.DataType) -> Column:
    """The value as a point in time: ISO text or a timestamp; numbers are epoch milliseconds."""
    if isinstance(dtype, T.VariantType):
        return F.coalesce(text_millis(as_text(v, dtype)).cast("double"), as_number(v, dtype))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_millis(v.cast("timestamp")).cast("double")
    if isinstance(dtype, T.StringType):
        return text_millis(v).cast("double")
    return as_number(v, dtype)


def exact_integer(v: Column, dtype: T.DataType, tag: Column | None = None) -> Column:
    """The value as BIGINT if it is an integer of that range, else NULL: doubles can't hold all of them."""
    if isinstance(dtype, T.VariantType):
        return F.when(_tag(v, tag).rlike(r"^(BIGINT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, "$", "bigint"))
    return v.cast("bigint") if isinstance(dtype, INTEGERS) else F.lit(None).cast("bigint")


def number_text(x: Column) -> Column:
    """A DOUBLE as text: whole numbers without a fraction, and no exponent from 1e-6 to 1e21."""
    size, bare = F.abs(x), lambda c: F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    whole = F.when(size < 1e15, x.cast("bigint").cast("string")).otherwise(x.cast("decimal(38,0)").cast("string"))
    return (
        F.when((x % 1 == 0) & (size < 1e21), whole)
        .when((size >= 1e7) & (size < 1e20), bare(x.cast("decimal(38,17)")))
        .when((size < 1e-3) & (size >= 1e-6), bare(x.cast("decimal(38,30)")))
        .otherwise(x.cast("string"))
    )


def key_text(v: Column, dtype: T.DataType, tag: Column | None = None) -> Column:
    """A value as a grouping or join key: null is `null`, 1 and "1" are equal, objects and arrays are their JSON."""
    if isinstance(dtype, T.VariantType):
        other = F.when(_tag(v, tag) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
        number = F.coalesce(exact_integer(v, dtype, tag).cast("string"), number_text(as_number(v, dtype, tag)))
        return F.when(is_null(v, dtype), "null").otherwise(F.coalesce(number, other))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = number_text(v.cast("double"))
    elif isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        text = F.regexp_replace(v.cast("string"), r"\.?0+$", "")
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(v)
    else:
        text = v.cast("string")
    return F.coalesce(text, F.lit("null"))
