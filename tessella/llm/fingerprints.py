"""Canonical exact fingerprints of documents. DataFrame functions only.

Canonical form: Unicode compatibility composition and full case folding (ICU, on
the JVM), white space folded to one space and trimmed. Its fingerprint is 128
bits of xxhash64 under two salts. Rows with a fingerprint that another row has
too are grouped by it and by their canonical bytes, so that a collision splits
the group; where it does, a row finds its own group by the SHA-256 of its bytes.

The fingerprint is an exact digest: two fingerprints are alike (1.0) if equal
and not at all (0.0) otherwise.

Neighbours in id order are found on a narrow table (id, hashes, size) that is
sorted by ranges and written; only the first and last rows of its partitions are
looked at together. Texts are shuffled once by row, and from each document the
beginning that its neighbour asks for is sent on.

Defined cases: null text is the empty text; a row without id sorts after all
others; rows with equal ids sort by a hash of the text, so a group of them is
spread over ranges like any others; rows equal in id and in 128 bits of their
text's hash are repeated rows, each the neighbour of the one before; a single
row is its own neighbour; texts of any length are read whole; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessella.llm.common import Workspace, split_join

_KEY = ("no_id", "id", "h1", "h2")


def canonical(text: Column) -> Column:
    composed = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"[\s\p{Z}\x{85}]+", " "))


def fingerprint(canon: Column) -> Column:
    """32 hex digits of a canonical text."""
    # bound once as a one-element array, so that the canonical text is not made for each half
    half = lambda salt, c: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(salt), c))), 16, "0")
    return F.element_at(F.transform(F.array(canon), lambda c: F.concat(half(1, c), half(2, c))), 1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_ = F.col(id_col).cast("long")
    return docs.select(id_.isNull().alias("no_id"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"), text.alias("text"))


def _facts(rows: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Each distinct row's key, size, fingerprint and number of repeats; the fingerprints of several, with how many (n_rows)."""
    size = F.length("text").cast("long").alias("n_chars")
    facts = rows.select(*_KEY, size, fingerprint(canonical(F.col("text"))).alias("fingerprint")).groupBy(*_KEY, "n_chars", "fingerprint").agg(F.count("*").alias("n"))
    facts = work.put(facts)
    return facts, work.put(facts.groupBy("fingerprint").agg(F.count("*").alias("n_rows")).filter("n_rows > 1"))


def _flagged(rows: DataFrame, same: DataFrame, total: int) -> DataFrame:
    found = split_join(rows, same, ["fingerprint"], total, "left")
    return found.withColumn("shared", F.col("n_rows").isNotNull()).drop("n_rows")


def groups(rows: DataFrame) -> DataFrame:
    """From (no_id, id, n, fingerprint, canon) the byte-equal groups of each fingerprint: `of` lists (sha, first_doc_id, n_copies)."""
    ids = F.when(~F.col("no_id"), F.col("id"))
    same = rows.groupBy("fingerprint", "canon").agg(F.min(ids).alias("first_doc_id"), F.sum("n").alias("n_copies"), F.count("*").alias("n_rows"))
    each = F.struct(F.sha2("canon", 256).alias("sha"), "first_doc_id", "n_copies")
    return same.groupBy("fingerprint").agg(F.collect_list(each).alias("of"), F.sum("n_rows").alias("n_rows"))  # more than one only in a collision


def _copies(found: DataFrame, work: Workspace) -> DataFrame:
    """`found`, whose `canon` is null where no other row has the fingerprint, with first_doc_id and n_copies, once for each of n."""
    found = work.put(found.withColumn("sha", F.sha2("canon", 256)))
    ids = F.when(~F.col("no_id"), F.col("id"))
    own = F.when(F.size("of") == 1, F.element_at("of", 1)).otherwise(F.element_at(F.filter("of", lambda g: g["sha"] == F.col("sha")), 1))
    shared = found.filter("canon is not null")
    listed = split_join(shared.drop("canon"), work.put(groups(shared)), ["fingerprint"], found.count()).withColumn("own", own)
    names = [c for c in found.columns if c not in ("canon", "sha")]
    alone = found.filter("canon is null").select(*names, ids.alias("first_doc_id"), F.lit(1).cast("long").alias("n_copies"))
    every = listed.select(*names, "own.first_doc_id", "own.n_copies").unionByName(alone)
    return every.select("*", ids.alias("doc_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("turn"))


def _ordered(facts: DataFrame, work: Workspace) -> DataFrame:
    """`facts` with a number that ascends in the order of descending ids."""
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("no_id"), F.col("id").desc(), F.col("h1"), F.col("h2")]
    return work.put(facts.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))


def neighbours(facts: DataFrame, work: Workspace) -> DataFrame:
    """Each row of `facts` with the key `to_*` of the row before it, and how many characters that one asks for (`asked`).

    Rows are numbered within sorted ranges; the last of a range is followed by the
    first of the next range that has any, the last of all by the first.
    """
    rows = _ordered(facts, work)
    part = F.shiftright("at", 33)
    ends = rows.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))  # a row a partition
    after = F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(Window.orderBy("part")))
    before = rows.join(F.broadcast(ends.select("part", "last", after.alias("after"))), part == F.col("part"))
    before = before.select(F.when(F.col("at") == F.col("last"), F.col("after")).otherwise(F.col("at") + 1).alias("at"), *[F.col(c).alias("to_" + c) for c in _KEY], F.floor(F.col("n_chars") / 3).cast("int").alias("asked"))
    return rows.join(before, "at").drop("at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint, first_doc_id, n_copies) of every row; first_doc_id is the least id of equal canonical bytes."""
    work, rows = Workspace(docs.sparkSession), _keyed(docs, id_col, text_col)
    facts, same = _facts(rows, work)
    flagged = _flagged(facts, same, facts.count()).withColumn("shared", F.col("shared") | (F.col("n") > 1))
    texts = rows.groupBy(*_KEY).agg(F.first("text").alias("text")).join(work.put(flagged).hint("merge"), list(_KEY))
    canon = F.when(F.col("shared"), canonical(F.col("text")))
    return _copies(texts.select("no_id", "id", "n", "n_chars", "fingerprint", canon.alias("canon")), work).select("doc_id", "n_chars", "fingerprint", "first_doc_id", "n_copies")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's, with their likeness."""
    work, rows = Workspace(docs.sparkSession), _keyed(docs, id_col, text_col)
    facts, same = _facts(rows, work)
    linked = _flagged(neighbours(facts, work), same, facts.count()).withColumn("shared", F.col("shared") | (F.col("n") > 1))
    # one text of each distinct row; both branches read the same shuffle
    texts = rows.groupBy(*_KEY).agg(F.first("text").alias("text")).join(work.put(linked).hint("merge"), list(_KEY))
    heads = texts.select(*[F.col("to_" + c).alias(c) for c in _KEY], F.substring("text", F.lit(1), F.col("asked")).alias("head"), F.col("fingerprint").alias("next_fingerprint"))
    part = F.floor(F.col("n_chars") / 3).cast("int")
    # of repeated rows all but one are followed by a row like themselves
    turn = F.struct("head", "next_fingerprint", F.lit(1).cast("long").alias("times"))
    again = F.struct(F.substring("text", F.lit(1), part).alias("head"), F.col("fingerprint").alias("next_fingerprint"), (F.col("n") - 1).alias("times"))
    turns = texts.join(heads.hint("merge"), list(_KEY)).select("*", F.explode(F.when(F.col("n") > 1, F.array(turn, again)).otherwise(F.array(turn))).alias("t"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - part), F.col("t.head"))
    made = turns.select(
        "no_id", "id", "n_chars", "fingerprint", F.col("t.times").alias("n"), F.when(F.col("shared"), canonical(F.col("text"))).alias("canon"), edited.alias("edited"),
        (F.col("fingerprint") == F.col("t.next_fingerprint")).cast("double").alias("near_next"),
    )
    made = made.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_fingerprint": fingerprint(canonical(F.col("edited")))}).drop("edited")
    return _copies(made, work).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        "near_next",
        "first_doc_id",
        "n_copies",
    )
