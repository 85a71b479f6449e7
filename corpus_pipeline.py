"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage reads the table that the stage before has written, decides on its
own input, and passes on the columns of `documents` that its input has; the last
gives the packed pieces. There is no SQL for the whole: the language model and
the tokenizer can't be expressed in it.

Defined cases, in every stage: other columns than those of `documents`, whatever
their names, are not passed on; null text is the empty text, which has no
language, is a copy of nothing, has no passage and no item; repeated rows are
rows of their own until near_duplicates keeps one; a row without id is judged by
its text like any other; an empty table gives an empty result; texts of any
length are read whole; ties are broken by the least id, then by a hash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import decontamination, language_id, near_dedup, packing, substring_dedup
from tessella.llm.common import DOCUMENT_COLUMNS, Workspace, released, table

#: Least share of a text's windows, as the network weighs them, that its language must have.
LEAST_SCORE = 0.5


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c in DOCUMENT_COLUMNS]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a language that the network knows and is sure of."""
    rows = docs.select(*_columns(docs))
    judged = language_id.identify(rows, language_id.fitted(rows))
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*rows.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: shingles of five words, similarity 0.8.

    Every row stands for itself, also if it repeats an id or has none; that of
    the least id stays, and one without id only if no row of the group has one.
    """
    rows, work = docs.select(*_columns(docs)), Workspace(spark)
    named = work.put(rows.withColumns({"__row": F.monotonically_increasing_id(), "__hash": F.xxhash64(*rows.columns)}))  # written, so that a row keeps its number
    found = near_dedup.near_duplicates(named, "__row", k=5, percent=80).select(F.col("doc_id").alias("__row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__hash", "__row"))["__row"]
    kept = named.select("doc_id", "__hash", "__row").join(found, "__row").groupBy("component_id").agg(first.alias("__row"))
    return named.join(kept, "__row", "left_semi").select(*rows.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 35 words or more that occur elsewhere; a text of which nothing is left goes."""
    rows = docs.select(*_columns(docs))
    cut = substring_dedup.remove_repeats(rows).filter("n_words = 0 or n_removed < n_words")
    own = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[own[c].alias(c) if c in own else F.col(c) for c in rows.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    rows = docs.select(*_columns(docs))
    found = decontamination.contaminated(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    key = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    return rows.join(found, key, "left_anti").select(*rows.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeats),
    ("decontamination", decontaminated),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    work, docs, before = Workspace(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with released():  # what the stage's operators have written
            docs = work.put(stage(spark, docs, sf_dir))
        if before is not None:
            work.drop(before)
        before = docs
    return docs
