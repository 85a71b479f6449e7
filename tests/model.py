"""Paths, filters and aggregates over Python values, row by row: what the engine must agree with."""

import re
from datetime import datetime, timezone


def parts(path):
    """Keys as text, `[*]` as ..., `[n]` as a number."""
    word, inside = "", False
    for c in path + ".":
        if c in ".[]":
            if word:
                yield (... if word == "*" else int(word) if word.isdigit() else word) if inside else word
            word, inside = "", c == "["
        else:
            word += c


def below(x, part):
    if isinstance(x, dict):
        return list(x.values()) if part is ... else [x[part]] if part in x else []
    if not isinstance(x, list):
        return []
    if part == "length":
        return [len(x)]
    if part is ...:
        return x
    return x[int(part) :][:1] if str(part).isdigit() else []


def values(row, path):
    """All values at a path; nothing lies below a null."""

    def walk(x, steps):
        if not steps:
            yield x
        elif x is not None:
            for y in below(x, steps[0]):
                yield from walk(y, steps[1:])

    return list(walk(row, list(parts(path))))


def is_number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def millis(x):
    if is_number(x):
        return float(x)
    if isinstance(x, str) and re.match(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?$", x):
        return datetime.fromisoformat(x.replace("Z", "+00:00")).replace(tzinfo=timezone.utc).timestamp() * 1000
    return None


def same(x, v):
    return type(x) is type(v) and x == v or is_number(x) and is_number(v) and x == v


def holds(row, path, op, v):
    def one(x):
        if op == "=":
            return same(x, v)
        if op == "!=":
            return not same(x, v)
        if op == "exists":
            return x is not None
        if op == "contains":
            return isinstance(x, str) and isinstance(v, str) and v in x or isinstance(x, list) and any(same(y, v) for y in x)
        if op == "startsWith":
            return isinstance(x, str) and x.startswith(v)
        a, b = millis(x), millis(v)
        if a is None or b is None:
            return False
        return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]

    return any(one(x) for x in values(row, path))
