"""Language identification with a byte convolutional network.

The network reads fixed-length byte windows: filters of several widths run over
one-hot bytes, each filter is max-pooled over the window, and a softmax layer
names the language. It is trained in numpy on a bounded sample of labelled rows,
drawn at random from all of each language, and on windows drawn at random from
their whole texts, as many of each language; it is applied to all windows of
every whole text, and a document takes the mean of its windows' distributions,
weighted by their length.

Defined cases: null text, or text without a letter -> `und` with score 0; rows
are judged one by one, so repeated rows get equal results; an empty table gives
an empty result; with no learnable label every text is `und`; ties between
languages go to the first by name. Columns other than the id, text and label are
ignored and kept, whatever their names, but for lang_pred and score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessella.llm import textkit

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
#: Bound of the training sample: labelled rows a language. Training steps a language, and windows a step.
ROWS_PER_LANGUAGE, STEPS_PER_LANGUAGE, BATCH = 300, 200, 64
UNKNOWN = "und"


class ByteConvNet:
    """Multi-width filters, max pooling, softmax; Adam on the cross entropy."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.rng = rng
        self.tables = {(w, k): rng.normal(0, 0.3 / w**0.5, (256, FILTERS)).astype(np.float32) for w in WIDTHS for k in range(w)}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int, rate: float = 4e-3) -> None:
        """Each step draws BATCH windows, each language as likely as any other."""
        params = [*self.tables.values(), self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        order = np.argsort(labels, kind="stable")
        counts = np.bincount(labels, minlength=len(self.languages))
        begin = np.cumsum(counts) - counts
        present = np.flatnonzero(counts)
        for step in range(1, steps + 1):
            y = self.rng.choice(present, BATCH)
            rows = order[begin[y] + (self.rng.random(BATCH) * counts[y]).astype(np.int64)]
            slow = min(1.0, 2 * (1 - (step - 1) / steps))  # the second half slows down to a stop
            for p, g, (m, v) in zip(params, self._gradients(windows[rows], y), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= slow * rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, features, peaks = len(x), [], []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            conv = sum(self.tables[w, k][x[:, k : k + span]] for k in range(w))
            at = conv.argmax(1)
            peaks.append(at)
            features.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
        raw = np.concatenate(features, 1) + self.bias
        hidden = np.maximum(raw, 0)
        p = softmax(hidden @ self.out + self.out_bias)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (raw > 0)
        grads, rows = [], np.arange(n)[:, None]
        columns = np.broadcast_to(np.arange(FILTERS), (n, FILTERS))
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(w):
                flat = x[rows, peaks[i] + k].astype(np.int64) * FILTERS + columns
                grads.append(np.bincount(flat.ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype(np.float32))
        return [*grads, back.sum(0), hidden.T @ p + 1e-4 * self.out, p.sum(0)]

    def paired(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """For each width (offset, whether it reads two bytes, table): two filter taps become one look-up."""
        found = []
        for w in WIDTHS:
            taps = [(k, True, (self.tables[w, k][:, None] + self.tables[w, k + 1][None]).reshape(-1, FILTERS)) for k in range(0, w - 1, 2)]
            found.append(taps + [(w - 1, False, self.tables[w, w - 1])] * (w % 2))
        return found

    def predict(self, windows: np.ndarray, paired: list) -> np.ndarray:
        """Distribution over the languages for windows of WINDOW bytes."""
        across = np.ascontiguousarray(windows.T).astype(np.int64)  # positions first: the maximum then runs over whole rows
        pairs = (across[:-1] << 8) | across[1:]
        features = []
        for w, taps in zip(WIDTHS, paired, strict=True):
            span = len(across) - w + 1
            conv = None
            for k, two, tab in taps:
                got = tab.take((pairs if two else across)[k : k + span], 0, mode="clip")
                conv = got if conv is None else np.add(conv, got, out=conv)
            features.append(np.maximum.reduce(conv, axis=0))
        return softmax(np.maximum(np.concatenate(features, 1) + self.bias, 0) @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def windows_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, zero-padded, with their row and their length."""
    sizes = np.diff(offs)
    counts = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), counts)
    begins = offs[:-1][rows] + textkit.ramp(counts) * WINDOW
    lengths = np.minimum(offs[1:][rows] - begins, WINDOW)
    at = begins[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < lengths[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), rows, lengths


def in_training(doc_id: Column) -> Column:
    """Rows that may be learned from: the remainder of the id's checksum is known and not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[str, str]]:
    """(language, whole text) of ROWS_PER_LANGUAGE rows of each language at most, drawn by a hash of their ids."""
    rows = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & in_training(F.col(id_col)))
    rows = rows.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit("sample")).alias("draw"), F.xxhash64(F.col(text_col)).alias("tie"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("draw", "tie"))  # limited before the shuffle
    picked = rows.withColumn("rank", rank).filter(F.col("rank") <= ROWS_PER_LANGUAGE).select("label", "text")
    return [(r["label"], r["text"]) for r in picked.collect()]


def train(sample: list[tuple[str, str]], seed: int = 7) -> ByteConvNet | None:
    """Fit on the sample, with shortened and upper-cased variants; None if there is nothing to learn."""
    sample = sorted((label, text) for label, text in sample if text.strip())
    languages = sorted({label for label, _ in sample})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    index = {x: i for i, x in enumerate(languages)}
    raw = [text.encode() for _, text in sample]
    whole = np.frombuffer(b"".join(raw), np.uint8)
    windows, rows, lengths = windows_of(whole, np.append(0, np.cumsum([len(x) for x in raw])))
    for i in range(len(windows)):
        draw, cut = rng.random(2)
        if draw < 0.3:
            text = windows[i, : lengths[i]].tobytes().decode(errors="ignore")
            new = (text.upper() if draw < 0.15 else text.lower()).encode()[:WINDOW]
            windows[i] = np.frombuffer(new.ljust(WINDOW, b"\0"), np.uint8)
        if cut < 0.5:
            windows[i, int(12 + 2 * cut * (WINDOW - 12)) :] = 0
    net = ByteConvNet(languages, seed)
    net.fit(windows, np.array([index[label] for label, _ in sample])[rows], STEPS_PER_LANGUAGE * len(languages))
    return net


def predictor(net: ByteConvNet | None, text_at: str, letter_at: str):
    """A mapInArrow function that adds lang_pred and score to whole batches."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paired = net.paired() if net else None
        for batch in batches:
            n = batch.num_rows
            pred, score = np.full(n, -1), np.zeros(n)
            letters = np.array(batch.column(letter_at).fill_null(False).to_numpy(zero_copy_only=False), bool)
            if net:
                for first, data, offs in textkit.pieces(batch.column(text_at)):
                    windows, rows, lengths = windows_of(data, offs) if len(data) else (np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), np.zeros(0, int))
                    total = np.zeros((len(offs) - 1, len(net.languages)))
                    for at in range(0, len(windows), 128):
                        part = slice(at, at + 128)
                        np.add.at(total, rows[part], net.predict(windows[part], paired) * lengths[part, None])
                    size = np.maximum(np.diff(offs), 1)
                    pred[first : first + len(size)] = total.argmax(1)
                    score[first : first + len(size)] = total.max(1) / size
            pred[~letters] = -1
            score[pred < 0] = 0
            names = np.array([*(net.languages if net else []), UNKNOWN], object)
            keep = [i for i, name in enumerate(batch.schema.names) if name != letter_at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(names[pred], pa.string()), pa.array(np.clip(score, 0, 1))],
                names=[*(batch.schema.names[i] for i in keep), "lang_pred", "score"],
            )

    return judge


def identify(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score; a column of either name in `docs` is replaced."""
    docs = docs.drop("lang_pred", "score")
    letter = "letter_" + uuid.uuid4().hex  # no column of `docs`
    seen = docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    schema = docs.schema.add("lang_pred", "string").add("score", "double")
    return seen.mapInArrow(predictor(net, text_col, letter), schema)


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteConvNet | None:
    return train(training_sample(docs, id_col, text_col, label_col))
