"""The elements of one array of a large JSON document, cut out by tasks that each read a part of the file.

A part does not show whether it starts inside a string, how deep, or at which
element. So a first scan notes for each part what it does to a reader in either
state (in a string or not): change of depth, commas by level. The driver chains
these notes, a few hundred bytes a part, and a second scan cuts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of a document that one task reads; smaller documents are parsed whole.
SPLIT_BYTES = 8 << 20
#: The parser's greatest nesting; a reader's state in which a part goes down further is not the true one.
DEEPEST = 1000
#: Rows of a batch that leaves a task.
BATCH_ROWS = 4096

_QUOTE, _SINGLE, _COMMA, _BACKSLASH, _OPEN = ord('"'), ord("'"), ord(","), ord("\\"), ord("[")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_MARK = _STEP != 0
_MARK[[_QUOTE, _SINGLE, _COMMA]] = True
_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*\[$')


class _Odd(Exception):
    """A document that is left to the parser as a whole."""


@dataclass(frozen=True)
class _Part:
    """How a reader enters a part: in a string, depth, element; the first byte of the array, and its end if it ends here."""

    inside: int
    depth: int
    element: int
    first: int
    end: int | None


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """(start, value): the text between commas, so that no row is longer than an element, with the first byte of its part.

    The parts must not change from scan to scan with the number of cores, so a
    session of its own holds their size.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)
    own.conf.set("spark.sql.files.openCostInBytes", SPLIT_BYTES)
    own.conf.set("spark.sql.files.minPartitionNum", 1)
    rows = own.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_block_start").alias("start"), "value")
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, rows._jdf.logicalPlan()), spark)


def _joined(texts: pa.Array) -> bytes:
    """A batch's texts with commas between them."""
    values = texts.cast(pa.binary())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b",")[0].as_py()


def _part(batches: Iterator[pa.RecordBatch]) -> tuple[int, bytes] | None:
    """The first byte's place and the text of a part; all but the first start with a comma."""
    start, texts = None, []
    for batch in batches:
        if batch.num_rows:
            start = batch.column("start")[0].as_py()
            texts.append(_joined(batch.column("value")))
    if start is None:
        return None
    return start, b",".join(texts) if start == 0 else b"," + b",".join(texts)


def _marks(data: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places, characters and depths of the marks outside of strings, and whether the end is inside of one."""
    buf = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_MARK[buf])
    what = buf[at]
    quote = what == _QUOTE
    slashes = np.flatnonzero(buf == _BACKSLASH)
    if len(slashes):
        last = np.flatnonzero(np.append(np.diff(slashes) != 1, True))
        lengths = np.diff(np.insert(last, 0, -1))
        escaped = slashes[last[lengths % 2 == 1]] + 1
        quote &= ~np.isin(at, escaped, assume_unique=True)
    state = (np.cumsum(quote) + inside) & 1
    out = (state == 0) & (what != _QUOTE)
    at, what = at[out], what[out]
    return at, what, np.cumsum(_STEP[what], dtype=np.int64), int(state[-1]) if len(state) else inside


def _facts(data: bytes, inside: int) -> dict | None:
    """What a part does to a reader: depths are relative; commas count by level while nothing was lower, `ends` are the places where each level was first left."""
    at, what, depth, after = _marks(data, inside)
    low = np.minimum(np.minimum.accumulate(depth), 0) if len(depth) else depth
    if len(low) and -low[-1] > DEEPEST:
        return None
    levels, counts = np.unique(depth[(what == _COMMA) & (depth == low)], return_counts=True)
    lower = np.flatnonzero(np.diff(low, prepend=0))
    return {
        "after": after, "net": int(depth[-1]) if len(depth) else 0, "low": int(low[-1]) if len(low) else 0, "single": bool((what == _SINGLE).any()),
        "commas": {int(x): int(n) for x, n in zip(levels, counts)}, "ends": {int(depth[i]): int(at[i]) for i in lower},
    }


def _first_element(data: bytes, root: str) -> int:
    """The place after the bracket that opens the array at the key `root` of the document."""
    at, what, depth, _ = _marks(data, 0)
    step = _STEP[what]
    opens, closes = np.flatnonzero((step > 0) & (depth == 2)), np.flatnonzero((step < 0) & (depth == 1))
    head, begin, found = b"", 0, []
    for i, o in enumerate(opens):
        head += data[begin : at[o] + 1]
        key = _KEY.search(head)
        if key and json.loads(key[1]) == root:
            found.append((int(at[o]) + 1, head))
        if i < len(closes):
            begin = int(at[closes[i]])
    if len(found) != 1:
        raise _Odd
    place, head = found[0]
    json.loads(head.removeprefix(b"\xef\xbb\xbf") + b"]}")  # what comes before is well formed, but for what is inside of other values
    return place


def heights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(height) the greatest depth of the JSON texts of each batch."""
    for batch in batches:
        if batch.num_rows:
            depth = _marks(_joined(batch.column("text")), 0)[2]
            yield pa.RecordBatch.from_pydict({"height": pa.array([int(depth.max(initial=0))], pa.int32())})


def _look(root: str) -> Callable:
    key = re.compile(re.escape(json.dumps(root, ensure_ascii=False).encode()) + rb"\s*:")

    def run(batches):
        if not (part := _part(batches)):
            return
        start, data = part
        first = 0
        if start == 0:
            try:
                first = _first_element(data, root)
            except (_Odd, ValueError):
                first = -1
            data = data[max(first, 0) :]
        named = max((m.start() for m in key.finditer(data)), default=-1)
        facts = {"first": first, "named": named, "by": [_facts(data, s) if s == 0 or start else None for s in (0, 1)]}
        yield pa.RecordBatch.from_pydict({"start": pa.array([start], pa.int64()), "facts": [json.dumps(facts)]})

    return run


def _plan(noted: list[tuple[int, dict]]) -> tuple[dict[int, _Part | None], int]:
    """How each part is entered (None after the array's end), and the number of commas between elements."""
    parts: dict[int, _Part | None] = {}
    inside, depth, element, ended = 0, 2, 0, False
    if not noted or noted[0][0] != 0 or noted[0][1]["first"] < 0:
        raise _Odd
    for start, facts in noted:
        own = facts["by"][inside]
        if own is None or own["single"]:
            raise _Odd
        if ended:
            if facts["named"] >= 0:  # it may be the key again, and the last one counts
                raise _Odd
            parts[start] = None
        else:
            end = own["ends"].get(str(1 - depth))
            parts[start] = _Part(inside, depth, element, facts["first"], end)
            element += own["commas"].get(str(2 - depth), 0)
            if end is not None:
                ended = True
                if facts["named"] > end:
                    raise _Odd
        inside, depth = own["after"], depth + own["net"]
    if not ended or inside or depth:
        raise _Odd
    return parts, element


def _cut(parts: dict[int, _Part | None], whole: bool) -> Callable:
    """(pos, start, text) of the elements that lie within a part, or of those that reach over its ends."""

    def run(batches):
        if not (part := _part(batches)):
            return
        start, data = part
        if (entered := parts[start]) is None:
            return
        data = data[entered.first :]
        at, what, depth, _ = _marks(data, entered.inside)
        end = len(data) if entered.end is None else entered.end
        cuts = at[(what == _COMMA) & (depth == 2 - entered.depth) & (at < end)]
        n = len(cuts) + 1
        text = np.delete(np.frombuffer(data, np.uint8)[:end], cuts)
        offsets = np.concatenate([[0], cuts - np.arange(n - 1), [len(text)]]).astype(np.int32)
        texts = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(text))
        reaching = sorted({0} if start else set()) + ([n - 1] if entered.end is None else [])
        inner = range(1 if start else 0, n - (entered.end is None))
        chosen = [texts.slice(inner.start, max(len(inner), 0))] if whole else [texts.slice(i, 1) for i in dict.fromkeys(reaching)]
        places = [inner.start] if whole else list(dict.fromkeys(reaching))
        for first, some in zip(places, chosen):
            for i in range(0, len(some), BATCH_ROWS):
                rows = some.slice(i, BATCH_ROWS)
                pos = np.arange(len(rows), dtype=np.int64) + entered.element + first + i
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(np.full(len(rows), start, np.int64)), rows], ["pos", "start", "text"])

    return run


def elements(spark: SparkSession, path: str, root: str) -> DataFrame | None:
    """(pos, text) of the elements of the array at `root`; None if the document is to be parsed whole.

    That is one whose array does not begin in the first part, which names the key
    again, uses single quotes, or is not balanced.
    """
    rows = _rows(spark, path)
    noted = sorted((r["start"], json.loads(r["facts"])) for r in rows.mapInArrow(_look(root), "start long, facts string").collect())  # a row a part
    try:
        parts, commas = _plan(noted)
    except _Odd:
        return None
    columns = "pos long, start long, text string"
    reaching = rows.mapInArrow(_cut(parts, False), columns).groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("texts"))
    whole = rows.mapInArrow(_cut(parts, True), columns).select("pos", "text")
    out = whole.union(reaching.select("pos", F.array_join(F.transform("texts", lambda x: x["text"]), "").alias("text")))
    return out if commas else out.filter(~F.col("text").rlike(r"^\s*$"))  # an empty array
