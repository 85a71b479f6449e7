import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from tessella.llm import near_dedup, substring_dedup, textkit
from tessella.llm.common import Workspace
from tessella.llm import components as components_module
from tessella.llm.components import components


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = ["a b\tc", None, "", "  x ", "é\u00a0b\x1cc d", "end", "Start"]
    for limit in (1, 1 << 20):
        got = []
        for _, data, offs in textkit.pieces(pa.array(texts), limit):
            words = textkit.Words(data, offs)
            raw = data.tobytes()
            for i in range(len(offs) - 1):
                got.append([raw[a:b].decode() for a, b in zip(words.start[words.first[i] : words.first[i + 1]], words.stop[words.first[i] : words.first[i + 1]], strict=True)])
        assert got == [brute.WORD.findall(t or "") for t in texts]
    sliced = pa.array(["x", "y z", None, "w"])[1:3]
    assert [len(textkit.Words(d, o).hash) for _, d, o in textkit.pieces(sliced)] == [2]


def test_hashes_follow_content():
    import pyarrow as pa

    (_, data, offs), = textkit.pieces(pa.array(["ab cd AB", "cd ab", "ab cd"]))
    plain, folded = textkit.Words(data, offs).hash, textkit.Words(data, offs, fold=True).hash
    assert plain[0] == plain[4] == plain[5] and plain[0] != plain[2] and folded[0] == folded[2]
    pairs = textkit.rolled(plain, np.array([0, 3, 5]), 2)
    assert pairs[0] == pairs[2] != pairs[1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, 1000 + i) for i in range(1, 200)] + [(i, i + 1) for i in range(2000, 2060)] + [(5, 5)]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark)).collect()}
    want = brute.components([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long"), Workspace(spark)).count() == 0


def test_few_edges_are_solved_at_once(spark, monkeypatch):
    """A chain, which takes several rounds, is written once and solved; by rounds and beyond the bound it comes out the same."""
    edges, found = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 1000), (800, 1000), (7, 7)], "u long, v long"), []
    for most in (components_module.ALONE, 100):
        monkeypatch.setattr(components_module, "ALONE", most)
        work = Workspace(spark)
        found.append((sorted(map(tuple, components(edges, work).collect())), work.n))
    assert found[0][0] == found[1][0] == sorted([(i, 0) for i in range(301)] + [(x, 800) for x in (800, 900, 1000)])
    assert found[0][1] == 2


def test_lists_are_merged_alike_in_one_task(spark, monkeypatch):
    """Lists that overlap become one; those that would become too large stay as they are."""
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 4)
    sizes = spark.createDataFrame([(i, 10) for i in range(40)], "rep long, n long")
    reps = [[1, 2], [2, 3], [1, 3], [5, 6, 7], [10, 11, 12], [12, 13, 14], [20, 21], [21, 22], [22, 23], [30, 31]]
    lists = spark.createDataFrame([(r, [10] * len(r)) for r in reps], "reps array<long>, sizes array<long>")
    want = [[1, 2, 3], [5, 6, 7], [10, 11, 12], [12, 13, 14], [20, 21, 22, 23], [30, 31]]
    for most in (1000, 0):
        monkeypatch.setattr(near_dedup, "ALONE", most)
        assert sorted(r["reps"] for r in near_dedup._merged(lists, sizes, Workspace(spark)).collect()) == want
    assert near_dedup._merged(lists.limit(0), sizes, Workspace(spark)).count() == 0


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(frame, corpus, k):
    found = near_dedup.near_duplicates(frame(corpus), k=k).collect()
    assert len(found) == len(corpus)
    want = brute.near_duplicates(corpus, k, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == want


def test_near_duplicates_in_branched_nodes(frame, writer, monkeypatch):
    """With tiny leaf nodes the groups are branched, and dealt into blocks at the end."""
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 6)
    monkeypatch.setattr(near_dedup, "DEPTH", 3)
    rows, base = [], writer.words(100)
    for i in range(60):
        rows.append((i, " ".join(writer.edited(base, 0.01))))
    rows += [(100 + i, " ".join(writer.words(40))) for i in range(20)]
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(rows), k=4).collect()}
    assert found == {i: v[1] for i, v in brute.near_duplicates(rows, 4, 80).items()}


def test_near_copies_do_not_meet_in_every_tree(frame, writer, monkeypatch):
    """A large group of near copies is compared in the first trees; the others only bring what is not joined yet."""
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 40)
    base, met, listed = writer.words(400), [], near_dedup._listed
    rows = [(i, " ".join(writer.edited(base, 0.004))) for i in range(300)] + [(1000 + i, " ".join(writer.words(40))) for i in range(20)]
    monkeypatch.setattr(near_dedup, "_listed", lambda rows: met.append(rows.count()) or listed(rows))
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(rows), k=4).collect()}
    assert found == {i: v[1] for i, v in brute.near_duplicates(rows, 4, 80).items()}
    assert sum(met) < 10 * len(rows)


def test_classes_of_links():
    rng = np.random.default_rng(4)
    for n, links in ((60, 25), (60, 60), (1, 0)):
        pairs = rng.integers(0, n, (links, 2))
        near = np.zeros((n, n), bool)
        near[pairs[:, 0], pairs[:, 1]] = near[pairs[:, 1], pairs[:, 0]] = True
        want = brute.components([(int(a), int(b)) for a, b in pairs if a != b])
        assert near_dedup.classes(near).tolist() == [want.get(i, i) for i in range(n)]
    assert not near_dedup.classes(np.ones((500, 500), bool)).any()


def test_near_duplicates_in_a_template_group(frame, writer, monkeypatch):
    """Documents that share a template stay below the threshold but for a few pairs, and their nodes don't separate."""
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 6)
    monkeypatch.setattr(near_dedup, "DEPTH", 3)
    rows, template = [], writer.words(150)
    for i in range(50):
        own = writer.words(9)
        rows += [(2 * i + j, " ".join(template + own + writer.words(16))) for j in range(2)]
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(rows), k=4).collect()}
    assert found == {i: i - i % 2 for i in range(100)} == {i: v[1] for i, v in brute.near_duplicates(rows, 4, 80).items()}


def test_recall_by_similarity(frame, writer, monkeypatch):
    """Pairs from the threshold up, among random texts and among texts that share a template, in nodes that must be branched."""
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 10)
    rows, template = [], writer.words(220)
    for i in range(160):
        base = template + writer.words(60) if i % 2 else writer.words(280)
        other = list(base)
        for _ in range(writer.r.randint(3, 13)):
            other[writer.r.randrange(len(other))] = writer.words(1)[0]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(rows), k=4).collect()}
    want = {i: v[1] for i, v in brute.near_duplicates(rows, 4, 80).items()}
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 60 and sum(found[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(found[i] in (want[i], i) for i in want)


def test_sketches_rule_out_only_what_is_far():
    """A pair at the threshold agrees in 38 of 64 places or fewer once in 8,400 times, in 32 or fewer once in 13 million."""
    import pyarrow as pa

    base = np.arange(64, dtype=np.uint8)
    for alike, want in ((38, [[1, 2]]), (33, [[1, 2]]), (20, [])):
        other = base.copy()
        other[alike:] += 100
        batch = pa.RecordBatch.from_arrays([pa.array([5, 5]), pa.array([1, 2]), pa.array([99, 99]), pa.array([base.tobytes(), other.tobytes()])], names=["node", "rep", "n", "bits"])
        assert [r for out in near_dedup._screen(80)(iter([batch])) for r in out.column("reps").to_pylist()] == want


def test_near_duplicates_odd_rows(frame, spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, None), (9, "q r s t u v"), (2, "q r s t u v")]
    df = frame(rows).withColumn("kept", F.lit("x")).withColumn("component_id", F.lit(1))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, k=4).collect()), key=repr)
    assert got == sorted([(7, 3, False), (7, 3, False), (3, 3, True), (None, None, True), (9, 2, False), (9, 2, False), (2, 2, True)], key=repr)
    assert near_dedup.near_duplicates(frame([])).count() == 0


def test_exhaustive_links():
    rng = np.random.default_rng(1)
    base = np.sort(rng.choice(10**6, 100, replace=False).astype(np.uint64))
    sets = [base, base[:90], base[5:], np.arange(10, dtype=np.uint64) + 10**7, base[:50]]
    assert near_dedup.linked(sets, 80) == [(0, 1), (0, 2)]
    assert near_dedup.linked(sets[:1], 80) == [] and near_dedup.linked([base, base[:79]], 80) == [] and near_dedup.linked([base, base[:80]], 80) == [(0, 1)]


@pytest.mark.parametrize("width", [35, 5])
def test_substring_dedup(frame, corpus, width):
    found = substring_dedup.remove_repeats(frame(corpus), width=width, keep_text=False).collect()
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute.without_repeats(corpus, width)}
    assert len(found) == len(corpus) and {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found} == want
    assert sum(x[1] for x in want.values()) > 500


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_substring_dedup_of_crowded_anchors(frame, corpus, monkeypatch, limit):
    monkeypatch.setattr(substring_dedup, "SHARD_ROWS", limit)
    found = substring_dedup.remove_repeats(frame(corpus), width=35).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {i: gone for i, _, gone, _ in brute.without_repeats(corpus, 35)}


def test_substring_dedup_odd_rows(frame, writer):
    text, other = " ".join(writer.words(40)), "x  y\tz"
    rows = [(1, text), (1, text), (None, text), (None, None), (5, other), (5, "")]
    df = frame(rows).withColumn("kept", F.lit(0)).withColumn("spare", F.lit("s"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], r["spare"]) for r in substring_dedup.remove_repeats(df).collect()), key=repr)
    assert got == sorted([(1, 40, 40, "", "s"), (1, 40, 40, "", "s"), (None, 40, 40, "", "s"), (None, 0, 0, "", "s"), (5, 3, 0, other, "s"), (5, 0, 0, "", "s")], key=repr)
    assert substring_dedup.remove_repeats(frame([])).count() == 0


def test_passages_are_compared_by_words():
    """A digest that two different passages share is refused, and equal segments that occur twice repeat as a whole."""
    text = b" ".join(b"w%d" % i for i in range(40))
    assert substring_dedup.matched([(b"d", text, 2)], 35) == [(b"d", [(0, 40)])] and substring_dedup.matched([(b"d", text, 1)], 35) == []
    longer = text + b" x"
    assert substring_dedup.matched([(b"d", text, 1), (b"e", longer, 1)], 35) == [(b"d", [(0, 40)]), (b"e", [(0, 40)])]
    with pytest.raises(ValueError):
        substring_dedup.matched([(b"d", text, 1), (b"d", longer, 1)], 35)


def test_split_join(spark, monkeypatch):
    from tessella.llm import common

    left = spark.createDataFrame([(i % 7 if i < 90 else 100 + i, i) for i in range(120)], "k int, v int")
    right = left.groupBy("k").agg(F.count("*").alias("n_rows")).filter("k <> 3")
    for parts in (10, 10_000):
        monkeypatch.setattr(common, "HOT_PARTS", parts)
        for how in ("inner", "left"):
            got = sorted(tuple(r) for r in common.split_join(left, right, ["k"], 120, how).select("k", "v", F.coalesce("n_rows", F.lit(-1))).collect())
            assert got == sorted(tuple(r) for r in left.join(right, "k", how).select("k", "v", F.coalesce("n_rows", F.lit(-1))).collect())


def test_automaton():
    rng = random.Random(4)
    for _ in range(60):
        texts = [([rng.choice("abc") for _ in range(rng.randint(1, 14))], rng.choice([1, 1, 2])) for _ in range(3)]
        automaton = substring_dedup.SuffixAutomaton()
        for text, n in texts:
            automaton.add(text, n)
        automaton.close()
        least = 3
        count = {}
        for text, n in texts:
            for i in range(len(text) - least + 1):
                key = tuple(text[i : i + least])
                count[key] = count.get(key, 0) + n
        for text, _ in texts:
            covered = {x for i in range(len(text) - least + 1) if count[tuple(text[i : i + least])] > 1 for x in range(i, i + least)}
            assert {x for a, b in automaton.repeated(text, least) for x in range(a, b)} == covered
