"""Near-duplicate detection by a chosen-path set similarity join.

A document's set holds its distinct k-word shingles (64-bit hashes of the words).
Documents start in the root of each tree. A node picks one of a fixed number of
minwise coordinates at random and, with the probability that makes up for the
similarity threshold, a second one; a document goes to the child named by its
minwise token there. Similar documents therefore keep meeting: at the threshold
a pair has about one common child a level. Small nodes are compared
exhaustively, first by sketches of 64 bytes that rule out what is clearly
different, then on full sets; large nodes are branched again, and independent
trees are repeated until the recall target is met. Exact copies of a set are folded to
one representative first.

Scale: tree keys are made by each document alone; node sizes are combinable
counts; only nodes of bounded size and bounded total set size are ever gathered
in one task. A node that keeps STUCK of its documents over STUCK_LEVELS levels, or is
large after DEPTH levels, is not branched further: it is first dealt into bounded blocks, which join documents that are nearly all alike. Then every
two of its documents that are still in different components are compared, block
against block: the members of its largest component, already joined, only meet
the others, so a node of near copies costs in proportion to its size, and one of
documents that share a template but no link costs the square of its size.

Large nodes of the first trees are compared before those of the others: what they
have joined need not meet again. Of the other trees, large nodes and what is below
them are left out where they are of one component, and one in which all but a block are of one component is
compared as above without being branched.

Few edges or lists (ALONE) are joined by one task, more by rounds of joins; the result is the same.

Defined cases: a null text or one without words has an empty set and is linked
with nothing; rows that share a doc_id are one vertex; a row without doc_id
can't be linked, has no component and is kept; an empty table gives an empty
result. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm import textkit
from tessella.llm.common import Workspace, split_join
from tessella.llm.components import ALONE, components, solved
from tessella.llm.textkit import U64

#: Trees, coordinates of the minwise embedding, levels of branching.
TREES, COORDINATES, DEPTH = 9, 64, 8
#: A node is no longer branched if it keeps such a share of the documents of the node so many levels above.
STUCK, STUCK_LEVELS = 0.85, 3
#: A node with at most so many documents and shingles in all is compared exhaustively.
NODE_ROWS, NODE_SHINGLES = 2000, 1_000_000
#: Roots whose large nodes are compared first.
FIRST_ROOTS = 2
_SEEDS = textkit.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_SIGNED = pa.int64()
#: Ids that are broadcast at most: 16 MB.
BROADCAST_IDS = 2_000_000
#: Deviations below the threshold at which a sketch rules a pair out: at 0.8 with fewer than 33 of 64 places alike, one pair in 13 million at the threshold.
_SLACK = 6.0


def _sets(batch: pa.RecordBatch, text_at: str, k: int):
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    for first, data, offs in textkit.pieces(batch.column(text_at)):
        words = textkit.Words(data, offs, fold=True)
        starts, rows = words.spans(k)
        grams = textkit.rolled(words.hash, starts, k)
        bounds = np.searchsorted(rows, np.arange(len(offs)))
        for i in range(len(offs) - 1):
            if bounds[i] < bounds[i + 1]:
                yield first + i, np.unique(grams[bounds[i] : bounds[i + 1]])
            elif words.first[i] < words.first[i + 1]:
                a, b = words.first[i], words.first[i + 1]
                yield first + i, textkit.spanned(words.hash, np.array([a]), np.array([b]))
            else:
                yield first + i, np.zeros(0, U64)


def _roots(threshold: float) -> list[int]:
    """Root coordinates, tree after tree: one each, and a second in a tree as often as the threshold asks for."""
    found, owed = [], 0.0
    for tree in range(TREES):
        found.append(2 * tree)
        owed += 1 / threshold - 1
        if owed >= 1 - 1e-9:
            found.append(2 * tree + 1)
            owed -= 1
    return found


def _minwise(grams: np.ndarray) -> np.ndarray:
    """The least of the set's 32-bit hashes at each coordinate."""
    low = (grams & U64(0xFFFFFFFF)).astype(np.uint32)
    flip, odd = (_SEEDS & U64(0xFFFFFFFF)).astype(np.uint32), (_SEEDS >> U64(32)).astype(np.uint32) | np.uint32(1)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        part = (low[at : at + 4096, None] ^ flip) * odd
        least = np.minimum(least, (part ^ (part >> np.uint32(15))).min(0))
    return least


def _sketch(text_at: str, k: int, roots: list[int]):
    """Per document: set size, 128-bit set digest, child keys of the roots, minwise tokens, and their low bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = textkit.mix(np.array(roots, U64) + U64(0xABCDEF12345))
        for batch in batches:
            n = batch.num_rows
            sizes, digests, bits = np.zeros(n, np.int64), [None] * n, [None] * n
            keys, signs = np.zeros((n, len(roots)), np.int64), np.zeros((n, COORDINATES), np.int16)
            for i, grams in _sets(batch, text_at, k):
                sizes[i] = len(grams)
                if len(grams):
                    digests[i] = xxhash.xxh3_128_digest(grams.tobytes())
                    least = np.array([textkit.mix(grams ^ s).min() for s in seeds])
                    keys[i] = textkit.mix(least ^ (seeds * U64(3))).view(np.int64)
                    tokens = _minwise(grams)
                    signs[i] = tokens.astype(np.uint16).view(np.int16)  # their low halves tell children apart well enough
                    bits[i] = (tokens & np.uint32(255)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), _lists(keys), _lists(signs), pa.array(bits, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "keys", "sign", "bits"],
            )

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _full(text_at: str, k: int):
    """Per document the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [None] * batch.num_rows
            for i, grams in _sets(batch, text_at, k):
                if len(grams):
                    sets[i] = grams.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "grams"])

    return run


def classes(near: np.ndarray) -> np.ndarray:
    """The least member of each item's class, given the symmetric matrix of links."""
    of = np.full(len(near), -1)
    for i in range(len(near)):
        if of[i] < 0:
            of[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & (of < 0))
                of[front] = i
    return of


def _nodes(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[list]]:
    """Columns of each node's rows, from rows sorted by node; a node may run over several batches."""
    node, rows = None, [[] for _ in names]
    for batch in batches:
        for key, *values in zip(*(batch.column(x).to_pylist() for x in ("node", *names)), strict=True):
            if key != node:
                if rows[0]:
                    yield rows
                node, rows = key, [[] for _ in names]
            for column, value in zip(rows, values, strict=True):
                column.append(value)
    if rows[0]:
        yield rows


def _screen(percent: int):
    """Rows (node, rep, n, bits) of small nodes to lists of the representatives that their sketches don't keep apart, with the sizes of their sets."""
    share = percent / 100
    least = int(np.ceil(COORDINATES * (share + (1 - share) / 256) - _SLACK * np.sqrt(COORDINATES * share * (1 - share))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[tuple[int, int]]] = []
        lists = lambda: pa.RecordBatch.from_arrays([pa.array([[x[at] for x in one] for one in out], pa.list_(pa.int64())) for at in (0, 1)], names=["reps", "sizes"])
        for reps, sizes, bits in _nodes(batches, ("rep", "n", "bits")):
            n, size = len(reps), np.array(sizes)
            grid = np.frombuffer(b"".join(bits), np.uint8).reshape(n, COORDINATES)
            same = np.zeros((n, n), np.uint8)
            for c in range(COORDINATES):
                same += grid[:, c, None] == grid[None, :, c]
            near = (same >= least) & (100 * size[:, None] >= percent * size[None]) & (100 * size[None] >= percent * size[:, None])
            of = classes(near)
            for root in np.unique(of):
                members = np.flatnonzero(of == root)
                if len(members) > 1:
                    out.append(sorted((reps[i], sizes[i]) for i in members))
            if len(out) > 5000:
                yield lists()
                out = []
        yield lists()

    return run


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (least of its class, member) for the classes that links of the given sets make; all pairs are compared."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    if n < 2:
        return []
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (sizes.sum() - both) else []
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    columns, owners = column[inverse[use]], owner[use]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(columns, kind="stable")
    columns, owners = columns[order], owners[order]
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(columns, [at, at + 4096])
        grid = np.zeros((n, 4096), np.float32)
        grid[owners[a:b], columns[a:b] - at] = 1
        common += grid @ grid.T
    near = np.empty((n, n), bool)
    for at in range(0, n, 256):
        some = slice(at, at + 256)
        near[some] = (100 + percent) * np.rint(common[some]).astype(np.int64) >= percent * (sizes[some, None] + sizes[None])
    of = classes(near)
    return [(int(root), i) for i, root in enumerate(of) if root != i]


def _compare(percent: int):
    """Rows (node, rep, grams), sorted by node within the partition, to confirmed edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for reps, raw in _nodes(batches, ("rep", "grams")):
            order = np.argsort(np.array(reps), kind="stable")
            out.extend((reps[order[x]], reps[order[y]]) for x, y in linked([np.frombuffer(raw[i], U64) for i in order], percent))
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], _SIGNED), pa.array([p[1] for p in pairs], _SIGNED)], names=["u", "v"])


def _children(threshold: float) -> Column:
    """Keys of a node's children that a document with minwise tokens `sign` goes to."""
    at = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(COORDINATES)).cast("int")
    child = lambda salt: F.xxhash64("node", at(salt), F.element_at("sign", at(salt) + 1))
    second = (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1000)) < int(1000 * (1 / threshold - 1))) & (at(1) != at(2))
    return F.when(second, F.array(child(1), child(2))).otherwise(F.array(child(1)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Two documents are linked if 100 * intersection >= percent * union of their
    sets; kept marks the least id of each component.
    """
    spark, work, threshold = docs.sparkSession, Workspace(docs.sparkSession), percent / 100
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    roots = _roots(threshold)
    sketch = work.put(texts.mapInArrow(_sketch("text", k, roots), "doc_id long, n_shingles long, digest binary, keys array<long>, sign array<short>, bits binary"))
    named = sketch.filter("doc_id is not null and digest is not null")
    heads = work.put(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")))
    total = sketch.count()
    copies = split_join(named.select("doc_id", "digest"), heads.filter("n_rows > 1"), ["digest"], total).filter("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    # a representative's keys and size; rows that repeat an id with another text stay rows of their own
    reps = named.join(heads.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
    reps = work.put(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "keys", "sign", "bits"))
    met = work.put(_met(reps.select("rep", "n", F.posexplode("keys").alias("tree", "node")), total * len(roots)))
    small = (F.col("n_rows") <= NODE_ROWS) & (F.col("n_shingles") <= NODE_SHINGLES) | (F.col("n_rows") == 2)
    nodes = lambda rows: rows.filter(small).select("node", "rep")

    def branched(large: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
        """The rows of the small nodes below large ones, those of nodes that are branched no further, and the tables that the former are read from."""
        own = [c for c in ("rep", "n", "component") if c in large.columns]
        # tokens go down with the rows, so that no level looks them up again
        large = work.put(large.join(reps.select("rep", "sign"), "rep").select(*own, "sign", "node", "n_rows", "n_shingles", F.array().cast("array<long>").alias("past")))
        found, crowded, made = [], [], [large]
        for level in range(DEPTH + 1):
            if large.isEmpty():
                break
            # what hardly shrinks are copies of one text: more levels would not part them
            stuck = F.lit(True) if level == DEPTH else F.coalesce(F.col("n_rows") >= F.get("past", F.lit(STUCK_LEVELS - 1)) * STUCK, F.lit(False))
            kept = work.put(large.filter(stuck).select("rep", "n", "node", "n_rows", "n_shingles"))
            if not kept.isEmpty():
                found.append(kept.select(F.xxhash64("node", F.pmod(F.xxhash64("node", "rep"), _blocks(F.col("n_rows"), F.col("n_shingles"), 1))).alias("node"), "rep"))
                crowded.append(kept)
            if level == DEPTH:
                break
            deeper = large.filter(~stuck).select(*own, "sign", F.slice(F.concat(F.array("n_rows"), "past"), 1, STUCK_LEVELS).alias("past"), F.explode(_children(threshold)).alias("node"))
            rows = work.put(_met(deeper, 2 * most).withColumn("sign", F.when(~small, F.col("sign"))))
            found.append(nodes(rows))
            made.append(rows)
            large, most = rows.filter(~small), rows.count()
        return found, crowded, made

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = lambda lists, facts: lists.distinct().select(F.xxhash64("reps").alias("node"), F.explode("reps").alias("rep")).join(facts, "rep").repartition(n, "node").sortWithinPartitions("node")

    def compared(lists: DataFrame) -> DataFrame:
        screened = work.put(together(lists, reps.select("rep", "n", "bits")).mapInArrow(_screen(percent), "reps array<long>, sizes array<long>").distinct())
        screened = work.put(_merged(screened, reps.select("rep", "n"), work))
        candidates = work.put(screened.select(F.explode("reps").alias("doc_id")).distinct())
        met = F.broadcast(candidates) if candidates.count() <= BROADCAST_IDS else candidates  # else the texts are shuffled to them
        full = texts.filter("doc_id is not null").join(met, "doc_id", "left_semi").mapInArrow(_full("text", k), "rep long, grams binary").filter("grams is not null")
        return together(screened, full).mapInArrow(_compare(percent), "u long, v long")

    found, crowded, made = [nodes(met)], [], []
    large, first = met.filter(~small), F.col("tree") < FIRST_ROOTS
    if not large.isEmpty():
        more, crowded, made = branched(large.filter(first), met.count())
        found += more
    edges = work.put(compared(_listed(_union(found))))
    for done in made:
        work.drop(done)
    if not (others := large.filter(~first)).isEmpty():
        apart = work.put(_apart(others, components(edges, work)))
        more, stuck, _ = branched(apart.filter("not alike"), met.count())
        crowded += [apart.filter("alike").select("rep", "n", "node", "n_rows", "n_shingles"), *stuck]
        if more:
            edges = edges.union(work.put(compared(_listed(_union(more)))))
    if crowded:
        across = work.put(_across(_union(crowded), components(edges, work), n))
        if not across.isEmpty():
            edges = edges.union(compared(across))
    linked_ = components(edges.union(copies), work).withColumnRenamed("vertex", "doc_id")
    return (
        sketch.select("doc_id", "n_shingles")
        .join(linked_, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _met(rows: DataFrame, most: int) -> DataFrame:
    """Rows (rep, n, node and more), `most` at most, of nodes where at least two representatives meet, and two components if they have any, with the node's size."""
    several = F.min("component") < F.max("component") if "component" in rows.columns else F.count("*") > 1
    sizes = rows.groupBy("node").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_shingles"), several.alias("several")).filter("several").drop("several")
    return split_join(rows, sizes, ["node"], most)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of those large nodes whose representatives `found` has in several components, with these; `alike` where all but a block's are of one."""
    of = found.select(F.col("vertex").alias("rep"), "component")
    rows = rows.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = rows.groupBy("node", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    nodes = parts.groupBy("node").agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.max(F.struct("rows", "shingles")).alias("main")).filter("parts > 1")
    alike = (F.col("rows") - F.col("main.rows") <= NODE_ROWS // 2) & (F.col("shingles") - F.col("main.shingles") <= NODE_SHINGLES // 2)
    return rows.join(F.broadcast(nodes.select("node", alike.alias("alike"))), "node")  # one row a large node: a small part of the rows


def _whole(most_rows: int, most_shingles: int):
    """All lists (reps, sizes) to those that `_merged` returns, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [b for b in batches if b.num_rows]
        if not lists:
            return
        of_list, sizes = (pa.Table.from_batches(lists)[c].combine_chunks() for c in ("reps", "sizes"))
        lengths, reps = of_list.value_lengths().to_numpy(), of_list.flatten().to_numpy()
        heads = reps[np.cumsum(lengths) - lengths]
        vertices, least = solved(np.repeat(heads, lengths), reps)
        shingles = np.zeros(len(vertices), np.int64)
        np.maximum.at(shingles, np.searchsorted(vertices, reps), sizes.flatten().to_numpy())
        bounded = (np.bincount(least, minlength=len(vertices)) <= most_rows) & (np.bincount(least, shingles, len(vertices)) <= most_shingles)
        order = np.argsort(least, kind="stable")
        order = order[bounded[least[order]]]
        starts = np.flatnonzero(np.diff(least[order], prepend=-1))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(vertices[order]))], names=["reps"])
        yield pa.RecordBatch.from_arrays([of_list.filter(pa.array(~bounded[least[np.searchsorted(vertices, heads)]]))], names=["reps"])

    return run


def _merged(lists: DataFrame, sizes: DataFrame, work: Workspace) -> DataFrame:
    """One list of all representatives that lists connect, where it is of bounded size: their sets are shipped once, not for each tree. Else the lists."""
    if (lists.agg(F.sum(F.size("reps"))).first()[0] or 0) <= ALONE:
        return lists.coalesce(1).mapInArrow(_whole(NODE_ROWS, NODE_SHINGLES), "reps array<long>")
    lists = lists.select("reps")
    pairs = lists.select(F.element_at("reps", 1).alias("u"), F.explode(F.slice("reps", F.lit(2), F.size("reps"))).alias("v"))
    found = components(pairs, work)
    of = found.join(sizes, found["vertex"] == sizes["rep"])
    bounded = of.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).filter((F.col("rows") <= NODE_ROWS) & (F.col("shingles") <= NODE_SHINGLES))
    bounded = work.put(bounded.select("component"))
    whole = found.join(bounded, "component").groupBy("component").agg(F.sort_array(F.collect_set("vertex")).alias("reps")).select("reps")
    rest = lists.withColumn("vertex", F.element_at("reps", 1)).join(found, "vertex").join(bounded, "component", "left_anti").select("reps")
    return whole.union(rest)


def _listed(rows: DataFrame) -> DataFrame:
    """The lists of representatives of nodes of bounded size."""
    return rows.groupBy("node").agg(F.sort_array(F.collect_set("rep")).alias("reps")).select("reps")


def _blocks(rows: Column, shingles: Column, parts: int) -> Column:
    """Blocks to deal so many rows and shingles into, so that `parts` blocks together are of bounded size."""
    return F.greatest(F.ceil(rows * parts / NODE_ROWS), F.ceil(shingles * parts / NODE_SHINGLES))


def _across(crowded: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Lists in which every two of a crowded node's representatives meet that `found` has in different components."""
    of = found.select(F.col("vertex").alias("rep"), "component")
    rows = crowded.select("node", "rep", "n").join(of, "rep", "left").select("node", "rep", "n", F.coalesce("component", "rep").alias("component"))
    parts = rows.groupBy("node", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    sizes = parts.groupBy("node").agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.max(F.struct("rows", "component", "shingles")).alias("main")).filter("parts > 1")
    dealt = sizes.select(
        "node", "main.component", _blocks(F.col("main.rows"), F.col("main.shingles"), 2).alias("alike"),
        _blocks(F.col("rows") - F.col("main.rows"), F.col("shingles") - F.col("main.shingles"), 2).alias("others"),
    ).withColumnRenamed("component", "main")
    met = rows.join(dealt, "node").repartition(n, "rep")
    hashed, alike = F.xxhash64("node", "rep"), F.col("component") == F.col("main")
    block = F.when(alike, F.col("others") + F.pmod(hashed, F.col("alike"))).otherwise(F.pmod(hashed, F.col("others")))
    last = F.when(alike, F.col("others")).otherwise(F.col("others") + F.col("alike")) - 1
    pairs = met.select("node", "rep", block.alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("b")).filter("a <> b")
    return _listed(pairs.select("rep", F.xxhash64("node", F.least("a", "b"), F.greatest("a", "b")).alias("node"))).filter("size(reps) > 1")


def oracle_sql(k: int, percent: int) -> str:
    """The same for DuckDB, over documents, by comparing all documents that share a shingle."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, [x for x in string_split_regex({lower}, '[\\x20\\x09-\\x0D]+') if x <> ''] AS w FROM documents),
sets AS (SELECT row, doc_id, CASE WHEN len(w) >= {k} THEN list_distinct([array_to_string(list_slice(w, i + 1, i + {k}), ' ') for i in range(0, len(w) - {k - 1})])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
each AS (SELECT row, doc_id, len(g) AS n, unnest(g) AS g FROM sets),
links AS (
  SELECT DISTINCT a AS a, b AS b FROM (
    SELECT x.row, y.row, any_value(x.doc_id) AS a, any_value(y.doc_id) AS b, any_value(x.n) + any_value(y.n) AS sizes, count(*) AS met
    FROM each x JOIN each y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY x.row, y.row) WHERE 100 * met >= {percent} * (sizes - met)),
reach AS (SELECT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(doc_id = coalesce(component_id, doc_id), true) AS kept
FROM sets LEFT JOIN least ON doc_id = a"""
