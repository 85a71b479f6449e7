"""Exact removal of word passages that repeat anywhere in the corpus.

A window is `width` consecutive words of one document; every word covered by a
window whose word sequence also starts elsewhere is removed. Reference shards
are held as suffix automata: documents are streamed through the automaton of
the shard that can match them, and the matching statistics with at least two
occurrences give the maximal spans to remove.

The corpus is its own reference, so a shard can't be broadcast to all documents
(every text would pass through the whole corpus, the square of the input).
Shards are cut by content instead: each window has an anchor, its run of
ANCHORS[0] words with the least hash. Equal windows have the same anchor, so the
windows of one anchor form a shard which is shipped to the documents' segments
around that anchor. All of it is decided on words, hashes only sort:

1. Anchors are counted; one that occurs once can't repeat.
2. The segments around the others are folded by their words, with their counts.
   The distinct ones of an anchor build the automaton of its shard, and are
   streamed through it.
3. An anchor with more than SHARD_ROWS distinct segments is not gathered: its
   segments are taken as texts and cut by longer anchors, at last as long as
   the window, where each shard holds one segment. This is the same method on
   finer shards and exact at each length.

A key that holds more than a 10,000th of a table's rows is never joined by
shuffle: there are fewer than 10,000 such keys, which are broadcast.

Defined cases: null text is no words; repeated rows are further occurrences of
their windows; rows are told apart by id and text hash (equal texts get equal
results, so a null id may share a key with any other); texts shorter than the
window lose nothing; texts of any length are read whole; an empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessella.llm import textkit
from tessella.llm.common import HOT_PARTS, Workspace, split_join
from tessella.llm.textkit import U64

WIDTH = 35
#: Words of an anchor: first, and where a shard is too large; then those of the whole window.
ANCHORS = (8, 20)
#: Distinct segments of a shard.
SHARD_ROWS = 1000
_KEY = ("doc_id", "text_hash")


class SuffixAutomaton:
    """Generalised suffix automaton of weighted sequences with occurrence counts."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, at: int, to: int, symbol) -> int:
        """The state of the path at+symbol alone, apart from longer strings that `to` also holds."""
        if self.length[to] == self.length[at] + 1:
            return to
        clone = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = clone
        while at >= 0 and self.next[at].get(symbol) == to:
            self.next[at][symbol] = clone
            at = self.link[at]
        return clone

    def add(self, sequence: list, weight: int = 1) -> None:
        last = 0
        for symbol in sequence:
            to = self.next[last].get(symbol)
            if to is not None:
                last = self._split(last, to, symbol)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                at = last
                while at >= 0 and symbol not in self.next[at]:
                    self.next[at][symbol] = new
                    at = self.link[at]
                if at >= 0:
                    self.link[new] = self._split(at, self.next[at][symbol], symbol)
                last = new
            self.count[last] += weight

    def close(self) -> None:
        """Carry the counts of prefixes to all substrings."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def repeated(self, sequence: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans (start, stop) made of substrings of at least `least` symbols that occur twice or more."""
        spans: list[tuple[int, int]] = []
        state = size = 0
        for i, symbol in enumerate(sequence):
            while state and (symbol not in self.next[state]):
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(symbol)
            if to is None:
                continue
            state, size = to, size + 1
            while state and self.count[state] < 2:
                state = self.link[state]
                size = self.length[state]
            if size >= least:
                start = i + 1 - size
                if spans and start <= spans[-1][1]:
                    spans[-1] = (min(start, spans[-1][0]), i + 1)
                else:
                    spans.append((start, i + 1))
        return spans


def _anchored(words: textkit.Words, width: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, row, first and last window start of each run of windows with one anchor."""
    starts, rows = words.spans(width)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    n = len(words.hash)
    grams = textkit.rolled(words.hash, np.arange(n - k + 1), k)
    value, at = grams.copy(), np.arange(len(grams))
    reach, need = 1, width - k + 1
    while reach < need:  # least of the next `reach` grams, the leftmost among equals
        step = min(reach, need - reach)
        better = value[step:] < value[:-step]
        value, at = np.where(better, value[step:], value[:-step]), np.where(better, at[step:], at[:-step])
        reach += step
    anchor = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    return grams[anchor[head]].view(np.int64), rows[head], starts[head], starts[tail]


def _occurrences(width: int, k: int):
    """Texts to rows (anchor, key, n, a, b) with window starts counted from the text's first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offs in textkit.pieces(batch.column("text")):
                words = textkit.Words(data, offs)
                anchor, rows, a, b = _anchored(words, width, k)
                base, at = words.first[rows], pa.array(rows + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), *(batch.column(x).take(at) for x in (*_KEY, "n")), pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))],
                    names=["anchor", *_KEY, "n", "a", "b"],
                )

    return run


def _spaced(words: textkit.Words, data: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words, each followed by one space, and where each begins; one more for the end."""
    sizes = words.stop - words.start
    begin = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 1, out=begin[1:])
    out = np.full(begin[-1], 32, np.uint8)
    letters = np.repeat(words.start, sizes) + textkit.ramp(sizes)
    out[letters + np.repeat(begin[:-1] - words.start, sizes)] = data[letters]
    return out.tobytes(), begin


def _segments(width: int):
    """Texts with their spots (anchor, a, b) to rows (anchor, digest, words, key, n, a); words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offs in textkit.pieces(batch.column("text")):
                words = textkit.Words(data, offs)
                text, begin = _spaced(words, data)
                spots = batch.column("spots").slice(first, len(offs) - 1)
                rows = np.repeat(np.arange(len(spots)), spots.value_lengths().to_numpy())
                anchor, a, b = (x.to_numpy() for x in spots.flatten().flatten())
                for at in range(0, len(rows), 20_000):
                    part = slice(at, at + 20_000)
                    base = words.first[rows[part]]
                    p, q = begin[base + a[part]].tolist(), (begin[base + b[part] + width] - 1).tolist()
                    segments = [text[x:y] for x, y in zip(p, q, strict=True)]
                    own = pa.array(rows[part] + first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[part]), pa.array([xxhash.xxh3_128_digest(x) for x in segments], pa.binary()), pa.array(segments, pa.binary()),
                         *(batch.column(x).take(own) for x in (*_KEY, "n")), pa.array(a[part])],
                        names=["anchor", "digest", "words", *_KEY, "n", "a"],
                    )

    return run


def matched(shard: list[tuple[bytes, bytes, int]], width: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """(digest, repeated spans) of a shard's distinct segments (digest, words, count)."""
    if len({x[0] for x in shard}) < len(shard):
        raise ValueError("two different passages have one 128-bit digest")
    if len(shard) == 1 and shard[0][2] > 1:  # all windows of a segment that occurs twice repeat
        return [(shard[0][0], [(0, shard[0][1].count(b" ") + 1)])]
    automaton, texts = SuffixAutomaton(), [text.split(b" ") for _, text, _ in shard]
    for text, (_, _, n) in zip(texts, shard, strict=True):
        automaton.add(text, n)
    automaton.close()
    found = ((digest, automaton.repeated(text, width)) for text, (digest, _, _) in zip(texts, shard, strict=True))
    return [x for x in found if x[1]]


def _matched(width: int):
    """Distinct segments (anchor, digest, words, n), sorted by anchor, to (anchor, digest, n_rows, spans) by their shard's automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, rows, out = None, [], {}, []

        def close() -> None:
            if shard:
                out.extend((now, digest, rows[digest], [{"a": s, "b": t} for s, t in spans]) for digest, spans in matched(shard, width))

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("anchor", "digest", "words", "n", "n_rows")]
            for anchor, digest, text, n, n_rows in zip(*columns, strict=True):
                if anchor != now:
                    close()
                    now, shard, rows = anchor, [], {}
                shard.append((digest, text, n))
                rows[digest] = n_rows
            yield _spans(out)
            out.clear()
        close()
        yield _spans(out)

    return run


def _spans(out: list) -> pa.RecordBatch:
    kinds = {"anchor": pa.int64(), "digest": pa.binary(), "n_rows": pa.int64(), "spans": pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))}
    columns = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with the row key: the id, -1 for null, and a hash of the text."""
    return docs.withColumns({"doc_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), "text_hash": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def repeated_spans(docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, spans) of documents with repeated windows; spans are word ranges [a, b), which may overlap."""
    texts = keyed(docs.select(F.col(id_col), F.col(text_col).alias("text")), id_col, "text").select(*_KEY, "text", F.lit(1).cast("long").alias("n"))
    return _repeated(texts, work, width, [k for k in ANCHORS if k < width] + [width])


def _repeated(texts: DataFrame, work: Workspace, width: int, lengths: list[int]) -> DataFrame:
    """As `repeated_spans`, of texts that occur n times each, with anchors of lengths[0] words; the others are for crowded shards."""
    found = work.put(texts.mapInArrow(_occurrences(width, lengths[0]), "anchor long, doc_id long, text_hash long, n long, a int, b int"))
    anchors = work.put(found.groupBy("anchor").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n")).filter("n > 1").drop("n"))
    met = split_join(found.drop("n"), anchors, ["anchor"], found.count())
    spots = met.groupBy(*_KEY).agg(F.collect_set(F.struct("anchor", "a", "b")).alias("spots"))
    segments = work.put(texts.join(spots, list(_KEY)).mapInArrow(_segments(width), "anchor long, digest binary, words binary, doc_id long, text_hash long, n long, a int"))
    work.drop(found)
    distinct = work.put(segments.groupBy("anchor", "digest", "words").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n")))
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "anchor long, digest binary, n_rows long, spans array<struct<a:int,b:int>>"
    crowded = None
    if len(lengths) > 1:  # an anchor as long as the window has one segment
        crowded = work.put(distinct.groupBy("anchor").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > SHARD_ROWS))
    if crowded is None or crowded.isEmpty():
        spans = _gathered(distinct, n).mapInArrow(_matched(width), kinds)
    else:
        total = distinct.count()
        held = distinct.withColumnRenamed("n_rows", "own_rows")
        large = split_join(held, crowded, ["anchor"], total).drop("n_rows").withColumnRenamed("own_rows", "n_rows")
        large = work.put(large.withColumns({"doc_id": F.monotonically_increasing_id(), "text_hash": F.lit(0).cast("long")}))
        inner = _repeated(large.select(*_KEY, F.col("words").cast("string").alias("text"), "n"), work, width, lengths[1:])
        finer = large.select(*_KEY, "anchor", "digest", "n_rows").join(inner, list(_KEY)).select("anchor", "digest", "n_rows", "spans")
        hot = crowded.filter(F.col("n_rows") > max(1, total // HOT_PARTS)).select("anchor")
        small = distinct.join(F.broadcast(hot), "anchor", "left_anti").join(crowded.select("anchor"), "anchor", "left_anti")
        spans = _gathered(small, n).mapInArrow(_matched(width), kinds).unionByName(finer)
    spans = work.put(spans)
    for done in [distinct, anchors] + ([] if crowded is None else [crowded]):
        work.drop(done)
    back = split_join(segments.select("anchor", "digest", *_KEY, "a"), spans, ["anchor", "digest"], segments.count())
    each = back.select(*_KEY, "a", F.explode("spans").alias("s")).select(*_KEY, F.struct((F.col("a") + F.col("s.a")).alias("a"), (F.col("a") + F.col("s.b")).alias("b")).alias("span"))
    return each.groupBy(*_KEY).agg(F.collect_set("span").alias("spans"))


def _gathered(distinct: DataFrame, n: int) -> DataFrame:
    """Shards of at most SHARD_ROWS rows, each in one task."""
    return distinct.repartition(n, "anchor").sortWithinPartitions("anchor")


def _cut(keep_text: bool):
    """Texts with their spans to (n_words, n_removed, kept words joined by one space, or their digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for first, data, offs in textkit.pieces(batch.column("text")):
                words = textkit.Words(data, offs)
                raw = data.tobytes()
                counts[first : first + len(offs) - 1] = np.diff(words.first)
                for i, spans in enumerate(batch.column("spans").slice(first, len(offs) - 1).to_pylist()):
                    p, q = words.first[i], words.first[i + 1]
                    keep = np.ones(q - p, bool)
                    for s in spans or ():
                        keep[s["a"] : s["b"]] = False
                    removed[first + i] = len(keep) - keep.sum()
                    if not removed[first + i]:
                        text = raw[offs[i] : offs[i + 1]]
                        kept[first + i] = text if keep_text else b" ".join(text.split())  # bytes.split() parts at the same six bytes
                    else:
                        spots = zip(words.start[p:q][keep].tolist(), words.stop[p:q][keep].tolist(), strict=True)
                        kept[first + i] = b" ".join([raw[x:y] for x, y in spots])
            result = pa.array(kept, pa.binary()).cast(pa.string()) if keep_text else pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            names = [x for x in batch.schema.names if x != "spans"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names if x != "text"), pa.array(counts), pa.array(removed), result],
                names=[*(x for x in names if x != "text"), "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """`docs` with n_words, n_removed and kept.

    kept is the text without its repeated passages (the text itself if nothing is
    removed, else the kept words joined by one space), or, without keep_text, the
    sha256 of the kept words joined by one space.
    """
    work = Workspace(docs.sparkSession)
    spans = repeated_spans(docs, work, id_col, text_col, width).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    others = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed", "kept")]
    rows = docs.select(*[F.col(c) for c in others], F.col(text_col).alias("text")) if text_col != "text" else docs.select(*others, "text")
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-1)) == F.col("__id"), F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash")]
    joined = rows.join(spans, key, "left").drop("__id", "__hash")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text") + ", n_words long, n_removed long, kept string"
    return joined.mapInArrow(_cut(keep_text), schema)


def oracle_sql(width: int = WIDTH) -> str:
    """The same for DuckDB, over documents: all windows, counted by their words."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents),
windows AS (SELECT row, spot, array_to_string(list_slice(w, spot + 1, spot + {width}), ' ') AS g FROM (SELECT row, w, unnest(range(0, len(w) - {width - 1})) AS spot FROM d WHERE len(w) >= {width})),
often AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT row, unnest(range(spot, spot + {width})) AS spot FROM windows JOIN often USING (g)),
each AS (SELECT row, unnest(range(0, len(w))) AS spot, unnest(w) AS word FROM d),
kept AS (SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY spot) AS text FROM each ANTI JOIN gone USING (row, spot) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (row)"""
