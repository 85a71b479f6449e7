"""Quality selection by importance resampling.

Two generative models of hashed word and word-pair counts are made: one of the
target texts, one of all raw texts. A document's log importance is the log ratio
of its probabilities under the two, the sum over its n-grams. Adding Gumbel noise
and taking the k greatest keys samples k documents without replacement in
proportion to their importance.

Scale: counts are made in numpy over whole Arrow batches, summed up by task, and
reach the driver as one number for each of the 2 x 2 x BUCKETS cells. The k-th
greatest key is found by narrowing histograms, not by a sort of all rows.

Defined cases: a null text or one without words has no n-grams and log
importance 0; texts of any length are read whole; repeated rows get equal keys; rows tied with the k-th key are all
kept; rows without an id draw from an id of their own; without target texts both
models are flat and all documents are alike; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tessella.llm import textkit
from tessella.llm.common import Workspace
from tessella.llm.textkit import U64

#: Buckets of words and as many of word pairs; pseudo-count of a bucket.
BUCKETS, PRIOR = 1 << 17, 2.0
#: Keys that are gathered at most to find the k-th.
GATHERED = 10_000


def _grams(words: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and word pair."""
    rows = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    starts, pair_rows = words.spans(2)
    pairs = textkit.rolled(words.hash, starts, 2)
    single = (words.hash % U64(BUCKETS)).astype(np.int64)
    return np.concatenate([single, (pairs % U64(BUCKETS)).astype(np.int64) + BUCKETS]), np.concatenate([rows, pair_rows])


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to compressed bytes, which shuffle at about half the size."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        body = [press.compress(t.as_buffer()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(body, pa.binary())], names=["doc_id", "body"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = [press.decompress(b.as_buffer()) for b in batch.column("body")]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string())], names=["text"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        for _, data, offs in textkit.pieces(batch.column("text")):
            total += np.bincount(_grams(textkit.Words(data, offs, fold=True))[0], minlength=2 * BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets over a column `text`, or `body` with compressed texts; 2 * BUCKETS numbers."""
    many = (lambda b: _count(_spread(b))) if "body" in texts.columns else _count
    rows = texts.mapInArrow(many, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * BUCKETS)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target to raw probability of each bucket; words and pairs are models of their own.

    The raw counts are scaled to as many tokens as the target has before PRIOR is
    added to both, so that what the target hardly could have shown tells nothing.
    """
    out = np.zeros(2 * BUCKETS)
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        t, r = target[part], raw[part]
        if t.sum():
            out[part] = np.log(t + PRIOR) - np.log(r * (t.sum() / r.sum()) + PRIOR)
    return out


def _score(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, data, offs in textkit.pieces(batch.column("text")):
                buckets, rows = _grams(textkit.Words(data, offs, fold=True))
                n = len(offs) - 1
                size[first : first + n] = np.bincount(rows, minlength=n)
                total[first : first + n] = np.bincount(rows, ratio[buckets], n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(total)], names=["doc_id", "n_features", "log_weight"]
            )

    return run


def kth_greatest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th greatest value of a column, by histograms of ever smaller ranges."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while low < high:
        width = (high - low) / 1024
        inside = rows.filter((F.col(column) >= low) & (F.col(column) <= high))
        if n <= GATHERED:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - 1]
        bins = inside.select(F.least(F.lit(1023), F.floor((F.col(column) - low) / width)).alias("bin"), column)
        found = {r["bin"]: r for r in bins.groupBy("bin").agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for at in sorted(found, reverse=True):
            if k <= found[at]["n"]:
                low, high, n = found[at]["low"], found[at]["high"], found[at]["n"]
                break
            k -= found[at]["n"]
    return low


def resample(docs: DataFrame, target_ids: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """(doc_id, n_features, log_weight, key, kept) of every row.

    `target_ids` has the doc_id of target texts; kept marks the round(share * rows) greatest keys.
    """
    work = Workspace(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a join by shuffle at every size: how many labels there are is not known
    bodies = texts.filter("text is not null and doc_id is not null").mapInArrow(_squeeze, "doc_id long, body binary")
    target = counts(bodies.join(target_ids.select("doc_id").hint("merge"), "doc_id", "left_semi").select("body"))
    ratio = log_ratio(target, counts(texts.select("text"))).astype(np.float32).astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))  # 4 bytes x 2 x BUCKETS
    scored = texts.mapInArrow(lambda batches: _score(shared.value.astype(np.float64))(batches), "doc_id long, n_features long, log_weight double")
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = work.put(scored.withColumn("key", F.col("log_weight") - F.log(-F.log(draw))))
    least = kth_greatest(keyed, "key", round(share * keyed.count()))
    return keyed.withColumn("kept", F.lit(False) if least is None else F.col("key") >= least)
