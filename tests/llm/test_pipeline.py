from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute


def test_one_row_of_each_group_stays(spark, frame, writer):
    """Repeated rows, rows without id and rows that share an id: one of each group passes near-dedup and substring_dedup."""
    a, b, c, d, e, f, g = (" ".join(writer.words(50)) for _ in range(7))
    rows = [(1, a), (1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (3, d), (4, d + " end"), (4, e), (None, f), (5, g), (5, g + " end"), (5, None)]
    docs = frame(rows).repartition(3)
    near = sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()), key=repr)
    assert [r for r in near if not (r[1] or "").startswith(g)] == sorted([(1, a), (2, b), (None, c), (3, d), (4, e), (None, f), (5, None)], key=repr)
    assert len(near) == 8
    left = corpus_pipeline.repeats(spark, corpus_pipeline.near_duplicates(spark, docs, ""), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in left if r["doc_id"] is not None) == sorted((i, t or "") for i, t in near if i is not None)
    assert {r["text"] for r in left if r["doc_id"] is None} == {c, f}


def test_pipeline(spark, frame, tmp_path, writer):
    """Each stage's decision is seen in what the next one gets."""
    english = lambda n: " ".join("the cat and dog " + x for x in writer.words(n))
    passage, item = " ".join(writer.words(60)), " ".join(writer.words(40))
    rows = [(i, english(40 + i), "en") for i in range(60)]
    rows += [(100, rows[3][1], "en"), (101, rows[3][1] + " end", "en"), (102, english(30) + " " + passage, "en"), (103, passage + " " + english(31), "en")]
    rows += [(104, english(20) + " " + item, "en"), (105, "123 456", "en"), (106, None, "en"), (None, english(25), "en")]
    frame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everyone = {r[0] for r in rows}
    assert set(kept["language_id"]) == everyone - {105, 106}
    want = brute.near_duplicates([(i, t) for i, t, _ in rows if i is not None and i not in (105, 106)], 5, 80)
    assert set(kept["near_dedup"]) == {i for i, v in want.items() if v[2]} | {None} and not {100, 101} & set(kept["near_dedup"])
    assert passage not in kept["substring_dedup"][102]["text"] and kept["substring_dedup"][5]["text"] == rows[5][1]
    assert all(r["n_chars"] == len(r["text"]) for r in kept["substring_dedup"].values())
    assert set(kept["substring_dedup"]) - set(kept["decontamination"]) == {104}
    assert set(kept["packing"]) == set(kept["decontamination"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect()), key=repr) == sorted(map(tuple, docs.select(key).collect()), key=repr)
    assert whole.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096


def test_stages_on_odd_tables(spark, frame, tmp_path, writer):
    """Empty tables, nulls in any column, clashing and missing columns, long texts."""
    text, item = " ".join(writer.words(60)), " ".join(writer.words(40))
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(None,) * 5, (1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", None, None), (4, (text + " ") * 300, None, "s", 1), (5, item, "en", "s", 2), (-1, item + " x", "en", "s", 2)]
    clash = {"__row": "a", "__hash": "b", "component_id": "c", "kept": "d", "n_words": "e", "spans": "f", "lang_pred": "g", "id": "h", "part": "i"}
    for rows in ([], odd):
        docs = frame(rows).withColumns({k: F.lit(v) for k, v in clash.items()})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            got = {r["doc_id"] for r in out.collect()}
            if name == "decontamination" and rows:
                assert got == {None, 1, 2, 3, 4}
        assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() >= len(rows)
    short = frame(odd).select("doc_id", "text")
    assert corpus_pipeline.repeats(spark, short, str(tmp_path)).columns == corpus_pipeline.near_duplicates(spark, short, str(tmp_path)).columns == ["doc_id", "text"]


def test_work_tables_go(spark, frame, tmp_path):
    import os

    from tessella.llm.common import Workspace, release_all, released

    work = Workspace(spark)
    path = work.put(frame([(1, "a")]))._tessella_path.replace("file://", "")
    with released():
        inner = Workspace(spark)
        other = inner.put(frame([(2, "b")]))._tessella_path.replace("file://", "")
    assert os.path.exists(path) and not os.path.exists(other)
    release_all()
    assert not os.path.exists(path)
