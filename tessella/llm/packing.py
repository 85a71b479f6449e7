"""Packing of token sequences by minimum bin slack.

Bins are filled one pattern at a time: the longest piece left is placed, and a
bitset subset-sum over the lengths still available finds the fullest feasible
combination for the rest of the bin. Those pieces are removed and the next bin
begins. Only lengths matter, so the search runs on the count of each length: at
most `capacity` numbers, whatever the corpus. A pattern is used as often as its
counts allow, so the number of patterns is bounded by the number of lengths as
well, not by the number of documents.

Pieces are then dealt to the patterns' slots by their number among the pieces of
their length. Numbers come from counts per length and bounded block, so a
length that a third of all pieces share is numbered in parallel.

Defined cases: a null or empty text is the end token alone; rows without an id
are packed like others; ties between equal lengths fall to any piece; rows that
repeat an id are packed separately; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tessella.llm import textkit
from tessella.llm.common import Workspace

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 1_000_000
#: Bytes of words and of their ids beyond which a worker forgets them.
CACHE_BYTES = 64 << 20
#: Pieces that are numbered as one, and that a task places.
BLOCK = 20_000
#: Bytes of texts whose words are looked up at once.
PIECE_BYTES = 1 << 19


def _fullest(counts: list[int], lengths: list[int], room: int) -> list[int]:
    """Of available lengths (descending), a combination that fills `room` as far as possible."""
    goal, reach, levels = 1 << room, 1, []
    mask = (1 << (room + 1)) - 1
    for size in lengths:
        n = min(counts[size], room // size) if size <= room else 0
        if not n:
            continue
        take = 1
        while n:
            used = min(take, n)
            n -= used
            take *= 2
            levels.append((size, used, reach))
            reach |= (reach << (size * used)) & mask
        if reach & goal:
            break
    best, chosen = reach.bit_length() - 1, []
    for size, used, before in reversed(levels):
        if not (before >> best) & 1:
            chosen += [size] * used
            best -= size * used
    return chosen


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of bins that together hold every length as often as it is counted."""
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        left[size] = n
    lengths, found = [x for x in range(capacity, 0, -1) if left[x]], []
    while lengths:
        first = lengths[0]
        left[first] -= 1
        bin_ = [first, *_fullest(left, lengths, capacity - first)]
        left[first] += 1
        need: dict[int, int] = {}
        for x in bin_:
            need[x] = need.get(x, 0) + 1
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        found.append((times, bin_))
        lengths = [x for x in lengths if left[x]]
    return found


def slots(found: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """Per length and pattern: length, first piece number, pieces a bin, first bin, offsets (ragged, with starts)."""
    rows, offsets, number, bins = [], [], {}, 0
    for times, bin_ in found:
        at, places = 0, {}
        for x in bin_:
            places.setdefault(x, []).append(at)
            at += x
        for x, spots in places.items():
            rows.append((x, number.get(x, 0), len(spots), bins, len(offsets)))
            number[x] = number.get(x, 0) + times * len(spots)
            offsets += spots
        bins += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table, np.array(offsets, np.int64)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads only add their overhead
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The normalizer and pre-tokenizer of tokenizers that part words into runs of letters, single digits and runs of other characters, and ignore case.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PARTED = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
#: First byte of the letters from U+00C0 to U+00FF, the second of the two signs among them, and of their capitals.
_LATIN, _SIGNS, _CAPITALS = 0xC3, (0x97, 0xB7), (0x80, 0x9E)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _plain(path: str):
    """The tokenizer of runs: what `_tokenizer` does after it has normalized and parted words."""
    from tokenizers import Tokenizer, pre_tokenizers

    out = Tokenizer(_tokenizer(path).model)
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


@lru_cache(maxsize=1)
def _kinds(path: str) -> np.ndarray | None:
    """The kind of each byte, 0 outside of words, if the tokenizer parts words into such runs; None if it may not."""
    with open(path, encoding="utf-8") as file:
        facts = json.load(file)
    if facts["normalizer"] != _NORMAL or facts["pre_tokenizer"] != _PARTED or not all(x["content"] for x in facts["added_tokens"]):
        return None
    kinds = np.full(256, _ODD, np.uint8)  # what is not ASCII, but for Latin letters, and control characters
    kinds[33:127] = _MARK
    kinds[48:58] = _DIGIT
    kinds[65:91] = kinds[97:123] = _LETTER
    kinds[ord("'")] = _ODD
    for token in facts["added_tokens"]:
        kinds[token["content"].encode()[0]] = _ODD
    kinds[textkit.SEPARATOR] = 0
    return kinds


def _runs(data: np.ndarray, offs: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, textkit.Words, np.ndarray]:
    """Bytes in lower case, the runs of letters, digits and other characters in words of ASCII and Latin letters, and which runs are odd: other words, each as it is."""
    kind, n, lower = kinds[data], len(data), _LOWER[data]
    latin = np.flatnonzero(data == _LATIN)
    second = data[latin + 1]
    kind[latin] = kind[latin + 1] = np.where(np.isin(second, _SIGNS), _ODD, _LETTER)
    lower[latin[(second >= _CAPITALS[0]) & (second <= _CAPITALS[1])] + 1] += 32
    row = np.zeros(n + 1, bool)
    row[offs] = True
    edge = row.copy()
    edge[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    places = np.flatnonzero(edge)
    start, stop = places[:-1], places[1:]
    inside = kind[start] != 0
    start, stop = start[inside], stop[inside]
    odd = kind[start] == _ODD
    if odd.any():
        new = row[start]
        new[0] = True
        new[1:] |= start[1:] != stop[:-1]
        word = np.cumsum(new) - 1
        odd = (np.bincount(word, odd) > 0)[word]
        start, stop, odd = start[new | ~odd], stop[np.append(new[1:], True) | ~odd], odd[new | ~odd]
        size = stop[odd] - start[odd]
        same = np.repeat(start[odd], size) + textkit.ramp(size)
        lower[same] = data[same]
    return lower, textkit.Words(lower, offs, spans=(start, stop)), odd


#: A control character that the vocabulary has a token for; it parts words that are tokenised as one text.
_PARTING = "\x01"
#: Words that are tokenised as one text.
_TOGETHER = 512


def _encode(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the number of each word's."""
    (parting,) = tokenizer.encode(_PARTING, add_special_tokens=False).ids
    flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), _TOGETHER):  # one call each, as an encoding is far larger than its ids
        run = words[i : i + _TOGETHER]
        (enc,) = tokenizer.encode_batch_fast([f" {_PARTING} ".join(run)], add_special_tokens=False)
        ids = np.array(enc.ids, np.uint32)
        cuts = np.flatnonzero(ids == parting)
        if len(cuts) != len(run) - 1:  # a word holds the character itself
            each = [x.ids for x in tokenizer.encode_batch_fast(run, add_special_tokens=False)]
            flat.append(np.array([y for x in each for y in x], np.uint32))
            sizes.append(np.array([len(x) for x in each], np.int64))
        else:
            flat.append(ids[ids != parting])
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
    return np.concatenate(flat), np.concatenate(sizes)


class _Grown:
    """An array that values are added to."""

    def __init__(self, kind: type):
        self.n, self.room = 0, np.zeros(0, kind)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            room = np.empty(max(n, len(self.room) * 5 // 4), self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : n] = values
        self.n = n


class _Words:
    """Numbered words, found by hash and compared by their bytes; some 30 bytes each besides their own, where an entry of a dict takes over 100."""

    def __init__(self):
        self.hash, self.data, self.bounds, self.slots = _Grown(textkit.U64), _Grown(np.uint8), _Grown(np.int64), np.full(1 << 12, -1, np.int32)
        self.bounds.add(np.zeros(1, np.int64))

    def __len__(self) -> int:
        return self.hash.n

    def __iter__(self) -> Iterator[bytes]:
        raw, bounds = self.data.all.tobytes(), self.bounds.all.tolist()
        return (raw[x:y] for x, y in zip(bounds, bounds[1:]))

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & textkit.U64(len(self.slots) - 1)).astype(np.int64)

    def find(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, -1 if it is unknown, and whether no word has its hash."""
        at, left, slot, known = np.full(len(hashes), -1), np.arange(len(hashes)), self._slot(hashes), self.hash.all
        while len(left):
            got = self.slots[slot]
            left, slot, got = left[got >= 0], slot[got >= 0], got[got >= 0]
            hit = known[got] == hashes[left]
            at[left[hit]] = got[hit]
            left, slot = left[~hit], (slot[~hit] + 1) % len(self.slots)
        free, hits = at < 0, np.flatnonzero(at >= 0)
        begin, size = self.bounds.all[at[hits]], (stop - start)[hits]
        alike = size == self.bounds.all[at[hits] + 1] - begin
        at[hits[~alike]] = -1
        hits, begin, size = hits[alike], begin[alike], size[alike]
        inside = textkit.ramp(size)
        other = data[np.repeat(start[hits], size) + inside] != self.data.all[np.repeat(begin, size) + inside]
        at[np.repeat(hits, size)[other]] = -1
        return at, free

    def add(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray, free: np.ndarray) -> np.ndarray:
        """Numbers of new words; of words of one hash, the first is found later."""
        numbers, size = np.arange(len(hashes)) + len(self), stop - start
        self.bounds.add(self.data.n + np.cumsum(size))
        self.data.add(data[np.repeat(start, size) + textkit.ramp(size)])
        self.hash.add(hashes)
        _, first = np.unique(hashes, return_index=True)
        found = numbers[first[free[first]]]
        if 2 * len(self) > len(self.slots):
            found = np.concatenate([self.slots[self.slots >= 0], found])
            self.slots = np.full(1 << (2 * len(self) - 1).bit_length(), -1, np.int32)
        slot = self._slot(self.hash.all[found])
        while len(found):
            empty = self.slots[slot] < 0
            self.slots[slot[empty]] = found[empty]
            lost = self.slots[slot] != found
            found, slot = found[lost], (slot[lost] + 1) % len(self.slots)
        return numbers


class _Vocabulary:
    """Ids of words, for at most CACHE_WORDS words and CACHE_BYTES besides those of the text at hand."""

    def __init__(self, path: str):
        self.path, self.place, self.ids, self.bounds = path, _Words(), _Grown(np.uint32), _Grown(np.int64)
        self.bounds.add(np.zeros(1, np.int64))

    @property
    def flat(self) -> np.ndarray:
        return self.ids.all

    def look_up(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin in `flat` and number of ids of each of the distinct words; what is not odd is a run."""
        at, free = self.place.find(data, start, stop, hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if len(self.place) and (len(self.place) + len(missing) > CACHE_WORDS or self.place.data.n + self.flat.nbytes > CACHE_BYTES):
                self.__init__(self.path)
                return self.look_up(data, start, stop, hashes, odd)
            missing = np.concatenate([missing[odd[missing]], runs := missing[~odd[missing]]])
            raw = data.tobytes()
            whole = [raw[x:y].decode() for x, y in zip(start[missing].tolist(), stop[missing].tolist(), strict=True)]
            for tokenizer, words in ((_tokenizer, whole[: len(whole) - len(runs)]), (_plain, whole[len(whole) - len(runs) :])):
                flat, size = _encode(tokenizer(self.path), words)
                self.bounds.add(self.ids.n + np.cumsum(size))
                self.ids.add(flat)
            at[missing] = self.place.add(data, start[missing], stop[missing], hashes[missing], free[missing])
        begin = self.bounds.all[at]
        return begin, self.bounds.all[at + 1] - begin


def _same(words: textkit.Words, data: np.ndarray, other: np.ndarray) -> bool:
    """Whether each word has the bytes of the word at `other`."""
    size, begin = words.stop - words.start, words.start[other]
    if not np.array_equal(size, size[other]):
        return False
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    shift = (8 * (8 - np.minimum(size, 8))).astype(textkit.U64)
    if not np.array_equal(eight[words.start] << shift, eight[begin] << shift):
        return False
    long = np.flatnonzero(size > 8)
    more = size[long] - 8
    inside = textkit.ramp(more) + 8
    return np.array_equal(data[np.repeat(words.start[long], more) + inside], data[np.repeat(begin[long], more) + inside])


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> _Vocabulary:
    return _Vocabulary(path)


def _pieces(path: str, capacity: int):
    """Texts to pieces: the words' ids one after another, the end token, cut at the capacity.

    The tokenizer parts text at white space before anything else, so a text's ids
    are those of its words; equal words are tokenised once. Where it parts words
    as `_kinds` knows, the same holds for the runs of a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, of_bytes = _vocabulary(path), _kinds(path)
        for batch in batches:
            out = {x: [] for x in ("row", "piece", "start", "length", "ids_crc32")}
            for first, data, offs in textkit.pieces(batch.column("text"), PIECE_BYTES):
                if of_bytes is None:
                    words = textkit.Words(data, offs)
                    odd = np.ones(len(words.start), bool)
                else:
                    data, words, odd = _runs(data, offs, of_bytes)
                _, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
                if not _same(words, data, at[inverse]):  # two words have one hash
                    at = inverse = np.arange(len(words.hash))
                begin, sizes = vocabulary.look_up(data, words.start[at], words.stop[at], words.hash[at], odd[at])
                each = sizes[inverse]
                stream = vocabulary.flat[np.repeat(begin[inverse], each) + textkit.ramp(each)]
                ends = np.append(0, np.cumsum(each))[words.first[1:]]
                bounds = np.append(0, ends + np.arange(1, len(offs))).tolist()  # with the end tokens
                tokens = memoryview(np.insert(stream, ends, np.uint32(END_ID)).astype("<u4").tobytes())
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for p, s in enumerate(range(0, b - a, capacity)):
                        length = min(capacity, b - a - s)
                        for name, value in zip(out, (first + i, p, s, length, zlib.crc32(tokens[4 * (a + s) : 4 * (a + s + length)])), strict=True):
                            out[name].append(value)
            rows = pa.array(out.pop("row"), pa.int64())
            keep = [x for x in batch.schema.names if x != "text"]
            kinds = {"piece": pa.int32()}
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x).take(rows) for x in keep), *(pa.array(v, kinds.get(x, pa.int64())) for x, v in out.items())], names=[*keep, *out]
            )

    return run


def _placed(table: np.ndarray, offsets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = (batch.column(x).to_numpy() for x in ("length", "number"))
            at = np.empty(len(size), np.int64)
            for x in np.unique(size):
                a, b = np.searchsorted(table[:, 0], [x, x + 1])
                mine = size == x
                at[mine] = a + np.searchsorted(table[a:b, 1], number[mine], "right") - 1
            row = table[at]
            place = number - row[:, 1]
            keep = [x for x in batch.schema.names if x != "number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in keep), pa.array(row[:, 3] + place // row[:, 2]), pa.array(offsets[row[:, 4] + place % row[:, 2]])],
                names=[*keep, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    cut = work.put(texts.mapInArrow(_pieces(tokenizer_path, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"))
    # capacity rows at most, however many pieces
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table, offsets = slots(patterns(counts, capacity))
    blocks = max(1, -(-sum(counts.values()) // BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks))
    dealt = cut.withColumn("block", block)
    # prefix sums over the blocks of one length: as many rows a length as there are blocks
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece")
    numbered = dealt.withColumn("number", F.row_number().over(within)).join(base, ["length", "block"]).withColumn("number", F.col("number") - 1 + F.col("base"))
    # a task and a file for as many pieces as a block has: where files are set up by child processes, each counts
    rows = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").coalesce(max(spark.sparkContext.defaultParallelism, blocks))
    return rows.mapInArrow(_placed(table, offsets), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
