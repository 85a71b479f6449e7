"""Benchmark passages in documents. DataFrame functions only.

A window is as many consecutive words of a document as a benchmark item has; a
document with fewer is one window. Windows and items carry a 64-bit SimHash of
their k-word shingles. Fingerprints are cut into BLOCKS blocks, and each item is
listed under every block value within the block's own radius: the radii sum to
RADIUS - BLOCKS + 1, so two fingerprints within RADIUS bits agree with a listed
value in a block at least, whatever the bits that differ. Joining windows with
that list gives the candidates; each is verified on its shingle multisets: the
sum of the smaller weights over the sum of the larger ones must reach the
threshold. The order of shingles plays no part, so a passage whose parts have
changed places is found as well.

Which windows are fingerprinted: an item's window of similarity s holds at least
s of the item's shingles, so it holds one of any 1 - s of them (and one more).
The rarest ones in the corpus are taken, and every window that holds any of them
in any place is fingerprinted. A window that holds none is below the threshold.
The documents are read once for the shingles that items have; the benchmark is
broadcast if its shingles are counted to be at most BROADCAST_ROWS, a larger one
is joined by a shuffle. A passage that very many documents hold makes rows for
each document by itself, and no pair of documents is ever formed.

The only loss is a window further than RADIUS bits from its item although it is
similar enough: by the binomial about one in 5,000 at exactly the threshold, and
none in a million from similarity 0.86 on.

Defined cases: null text has no words; an item or window shorter than the
shingle is one shingle of all its words; an item without words matches nothing;
rows are told apart by id (null is an id of its own) and text hash, equal ones
give equal rows once; repeated items match each; of a document's windows that
are equally similar to an item the first is named; texts of any length are read
whole; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessella.llm.common import Workspace

SHINGLE, PERCENT, RADIUS, BITS, BLOCKS = 5, 80, 20, 64, 5
#: Rows that are broadcast at most: about 64 MB.
BROADCAST_ROWS = 1_000_000
#: Shingles of one window that packed counters of 16 bits can hold.
_PACKED = (1 << 14) - 1
_LANES = 0x0001000100010001


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    folded = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(folded == "", F.array().cast("array<string>")).otherwise(F.split(folded, " "))


def _runs(tokens: Column, k: int) -> Column:
    """64-bit hash of the k words from each word on; none if they are fewer."""
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))

    # bound once as a one-element array, so that the hashes are not made again for each use
    return F.when(F.size(tokens) >= k, F.element_at(F.transform(F.array(hashed), runs), 1)).otherwise(F.array().cast("array<long>"))


def shingles(tokens: Column, k: int) -> Column:
    """64-bit hash of the k words from each word on; of all words if they are fewer."""
    found = _runs(tokens, k)
    for n in range(1, k):
        found = F.when(F.size(tokens) == n, _runs(tokens, n)).otherwise(found)
    return found


def simhash(grams: Column) -> Column:
    """The majority of the shingles' bits, at each of BITS places."""
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)

    def bit(b: Column) -> Column:
        votes = F.aggregate(grams, F.lit(0), lambda acc, g: acc + F.when(g.bitwiseAND(one(b)) != 0, 1).otherwise(-1))
        return F.when(votes > 0, one(b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def packed_simhash(grams: Column) -> Column:
    """As `simhash`, counting four places in each of 16 numbers; for at most _PACKED shingles."""
    right = lambda x, n: F.call_function("shiftrightunsigned", x, n)
    zeros = F.array(*[F.lit(0).cast("long")] * 16)
    counts = F.aggregate(grams, zeros, lambda acc, g: F.transform(acc, lambda c, j: c + right(g, j).bitwiseAND(F.lit(_LANES))))
    # a count above half carries into bit 14 of its lane
    rest = (F.lit((1 << 14) - 1).cast("long") - F.floor(F.size(grams) / 2).cast("long")) * F.lit(_LANES)
    bits = F.transform(counts, lambda c, j: right(F.shiftleft((c + rest).bitwiseAND(F.lit(_LANES << 14)), 1), F.lit(15) - j))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def fingerprint(grams: Column) -> Column:
    return F.when(F.size(grams) <= _PACKED, packed_simhash(grams)).otherwise(simhash(grams))


def allotted(radius: int, blocks: int = BLOCKS) -> list[tuple[int, int, int]]:
    """(first bit, bits, own radius) of each block; a radius below 0 means that the block is not needed."""
    edges, total = [BITS * i // blocks for i in range(blocks + 1)], radius - blocks + 1
    return [(a, b - a, total // blocks + (i < total % blocks)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def blocks(print_: Column, radius: int = RADIUS) -> Column:
    """(number, value) of the blocks of a fingerprint."""
    cut = [(i, F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << n) - 1)).cast("int")) for i, (a, n, own) in enumerate(allotted(radius)) if own >= 0]
    return F.array(*[F.struct(F.lit(i).alias("number"), value.alias("value")) for i, value in cut])


def listed(items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`items` once for each (number, value) within the block's own radius of a block of `item_print`."""
    sizes = F.array(*[F.struct(F.lit(n).alias("bits"), F.lit(own).alias("own")) for _, n, own in allotted(radius) if own >= 0])
    each = items.select(*items.columns, F.explode(F.arrays_zip(blocks(F.col("item_print"), radius).alias("b"), sizes.alias("s"))).alias("z"))
    each = each.select(*items.columns, "z.b.number", F.col("z.b.value").alias("centre"), "z.s.own", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("z.s.bits")) - 1)).alias("mask"))
    return each.filter(F.bit_count("mask") <= F.col("own")).select(*items.columns, "number", F.col("centre").bitwiseXOR(F.col("mask")).alias("value"))


def common_weight(a: Column, b: Column) -> Column:
    """Sum over the shingles of a and b of the smaller of their counts."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    met = F.array_intersect(a, b)  # distinct ones
    single = F.size(F.array_distinct(a)) == F.size(a)
    return F.when(single, F.size(met)).otherwise(F.aggregate(met, F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x))))


_KEY = ("no_id", "id", "text_hash")


def _hits(texts: DataFrame, places: DataFrame, sizes: list[int], placed) -> DataFrame:
    """(key, k, gram, at, doc_words) of every shingle of a text that items have; one pass for all shingle sizes."""
    seen = texts.select(*_KEY, words(F.col("text")).alias("w"))
    runs = seen.select(*_KEY, F.size("w").alias("doc_words"), F.posexplode(F.concat(*[_runs(F.col("w"), k) for k in sizes])).alias("at", "gram"))
    size, before, begin = F.lit(sizes[0]), F.lit(0), F.lit(0)
    for shorter, k in zip(sizes, sizes[1:]):  # where the runs of k words begin in the array
        begin = begin + F.greatest(F.col("doc_words") - (shorter - 1), F.lit(0))
        size, before = F.when(F.col("at") >= begin, k).otherwise(size), F.when(F.col("at") >= begin, begin).otherwise(before)
    runs = runs.select(*_KEY, "doc_words", size.cast("int").alias("k"), (F.col("at") - before).cast("int").alias("at"), "gram")
    return runs.join(placed(places.select("k", "gram").distinct()), ["k", "gram"]).distinct()


def _probes(places: DataFrame, hits: DataFrame, percent: int, placed) -> DataFrame:
    """(k, gram, n_words, m): of each item the rarest shingles of which a window above the threshold must hold one."""
    counts = hits.groupBy("k", "gram").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("often", F.lit(0)), "gram", "item_at"))
    needed = F.col("m") - F.ceil(F.col("m") * percent / 100) + 1
    return places.join(counts, ["k", "gram"], "left").withColumn("rank", rank).filter(F.col("rank") <= needed).filter("often is not null").select("k", "gram", "n_words", "m").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, item_id, start, n_words, common, total) of the best window of each document for each item that it holds.

    start counts words from 0; common / total is the similarity, at least percent / 100.
    """
    work = Workspace(docs.sparkSession)
    cut = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w")).filter("size(w) > 0")
    cut = cut.select("item_id", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(k)).alias("k"), shingles(F.col("w"), k).alias("item_grams")).distinct()
    items = work.put(cut.withColumns({"m": F.size("item_grams"), "item_print": fingerprint(F.col("item_grams")), "item": F.xxhash64("n_words", "item_grams")}))
    places = items.dropDuplicates(["item"]).select("item", "n_words", "k", "m", F.posexplode("item_grams").alias("item_at", "gram"))
    n_places = places.count()
    key = [F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")]
    texts = docs.select(*key, F.col(text_col).alias("text"))
    placed = F.broadcast if n_places <= BROADCAST_ROWS else lambda x: x
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect()) or [k]  # k values at most
    hits = work.put(_hits(texts, places, sizes, placed))
    probes = work.put(_probes(places, hits, percent, placed))
    # starts of the windows of n_words that hold the shingle at `at`, less those that hold the one before
    spots = hits.join(placed(probes), ["k", "gram"]).select(*_KEY, "doc_words", "k", "n_words", "m", "at").distinct()
    past = F.lag("at", 1, -1).over(Window.partitionBy(*_KEY, "n_words").orderBy("at"))
    last = F.greatest(F.col("doc_words") - F.col("n_words"), F.lit(0))
    spots = spots.withColumns({"lo": F.greatest(F.col("at") - F.col("m") + 1, past + 1, F.lit(0)), "hi": F.least(F.col("at"), last)})
    spots = work.put(spots.filter("lo <= hi").groupBy(*_KEY).agg(F.collect_set(F.struct("n_words", "m", "k", "lo", "hi")).alias("spots")))
    # few documents share rare shingles with a benchmark; where they are many, the texts are shuffled to them
    met = F.broadcast(spots) if spots.agg(F.coalesce(F.sum(F.size("spots") + 1), F.lit(0))).first()[0] <= BROADCAST_ROWS else spots
    regions = texts.join(met, list(_KEY)).select(*_KEY, "spots", words(F.col("text")).alias("w")).select(*_KEY, "spots", F.array(*[_runs(F.col("w"), n) for n in sizes]).alias("g"))
    of = F.element_at(F.col("g"), F.array_position(F.array(*[F.lit(n) for n in sizes]), F.col("s.k")).cast("int"))
    regions = regions.select(*_KEY, "g", F.explode("spots").alias("s")).select(*_KEY, "s.n_words", "s.m", "s.lo", "s.hi", F.slice(of, F.col("s.lo") + 1, F.col("s.hi") - F.col("s.lo") + F.col("s.m")).alias("region"))
    regions = work.put(regions.dropDuplicates([*_KEY, "n_words", "lo"]))
    window = F.slice("region", F.col("start") - F.col("lo") + 1, F.col("m"))
    windows = regions.select("*", F.explode(F.sequence("lo", "hi")).alias("start")).select(*_KEY, "n_words", "lo", "start", fingerprint(window).alias("print"))
    left = windows.select("*", F.explode(blocks(F.col("print"), radius)).alias("b")).select(*_KEY, "n_words", "lo", "start", "print", "b.number", "b.value")
    table = work.put(listed(items.select("item", "n_words", "item_print").distinct(), radius))
    near = left.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, ["n_words", "number", "value"])
    near = work.put(near.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).select(*_KEY, "n_words", "lo", "start", "item").distinct())
    both = near.join(regions, [*_KEY, "n_words", "lo"]).select(*_KEY, "n_words", "start", "item", window.alias("grams")).join(placed(items.select("item", "item_id", "item_grams")), "item")
    both = both.withColumn("common", common_weight(F.col("grams"), F.col("item_grams")).cast("long"))
    both = both.withColumn("total", (F.size("grams") + F.size("item_grams") - F.col("common")).cast("long")).filter(F.col("common") * 100 >= F.col("total") * percent)
    best = F.max(F.struct((F.col("common") / F.col("total")).alias("likeness"), (-F.col("start")).alias("back"), "n_words", "common", "total")).alias("best")
    return both.groupBy(*_KEY, "item_id").agg(best).select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "text_hash", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"), "best.common", "best.total"
    )


def oracle_sql(k: int = SHINGLE, percent: int = PERCENT) -> str:
    """The same for DuckDB, over documents and benchmark: all windows of a document that share a shingle with an item, without fingerprints."""
    split = r"CASE WHEN f = '' THEN [] ELSE string_split(f, ' ') END"
    fold = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"
    grams = "unnest(range(0, len(w) - k + 1)) AS pos"
    return f"""
WITH d AS (SELECT row, doc_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS row, doc_id, {split} AS w FROM (SELECT doc_id, {fold} AS f FROM (SELECT DISTINCT doc_id, text FROM documents)))),
i AS (SELECT item_id, w, len(w) AS n, least(len(w), {k}) AS k FROM (SELECT item_id, {split} AS w FROM (SELECT DISTINCT item_id, {fold} AS f FROM benchmark)) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM i),
ds AS (SELECT row, k, pos, array_to_string(list_slice(w, pos + 1, pos + k), ' ') AS g FROM (SELECT row, k, w, {grams} FROM d, ks WHERE len(w) >= k)),
its AS (SELECT item_id, n, k, pos, array_to_string(list_slice(w, pos + 1, pos + k), ' ') AS g FROM (SELECT item_id, n, k, w, {grams} FROM i)),
want AS (SELECT item_id, n, k, g, count(*) AS c FROM its GROUP BY ALL),
hits AS (SELECT ds.row, item_id, want.n, k, pos, g, c, greatest(d.n - want.n, 0) AS last FROM ds JOIN want USING (k, g) JOIN d USING (row)),
have AS (
  SELECT row, item_id, n, k, start, g, c, count(*) AS own
  FROM (SELECT *, unnest(CASE WHEN last = 0 THEN [0] ELSE range(greatest(pos - (n - k), 0), least(pos, last) + 1) END) AS start FROM hits) GROUP BY ALL),
met AS (SELECT row, item_id, have.n, start, sum(least(own, c)) AS common, least(have.n, any_value(d.n)) + have.n - 2 * (k - 1) AS sizes FROM have JOIN d USING (row) GROUP BY row, item_id, have.n, k, start),
found AS (SELECT *, sizes - common AS total FROM met WHERE common * 100 >= (sizes - common) * {percent})
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(found.n AS BIGINT) AS n_words, CAST(common AS BIGINT) AS common, CAST(total AS BIGINT) AS total
FROM found JOIN d USING (row) QUALIFY row_number() OVER (PARTITION BY row, item_id ORDER BY common / total DESC, start) = 1"""
