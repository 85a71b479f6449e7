import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from tessella.llm import html_extraction, html_pages, language_id, packing, quality

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_language_of_held_out_documents(spark):
    from tessella.llm.queries import op2_language_id

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op2_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == brute.held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_odd_rows(spark, frame):
    rows = [(i, t * 30, lang) for i in range(40) for t, lang in (("the cat is here ", "en"), ("le chat est là ", "fr"))]
    net = language_id.fitted(frame(rows))
    assert net.languages == ["en", "fr"]
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "the cat"), (4, "the cat"), (None, "le chat est là " * 4000), (6, "\x00")]
    df = frame(odd).withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit(1))
    got = [(r["lang_pred"], r["score"]) for r in language_id.identify(df, net).collect()]
    assert [g[0] for g in got] == ["und", "und", "und", "en", "en", "fr", "und"] and got[0][1] == 0 and got[3] == got[4]
    assert language_id.identify(frame([]), net).count() == 0
    nothing = language_id.fitted(frame([(1, "a", None), (2, None, "en"), (None, "x", "en")]))
    assert nothing is None and language_id.identify(frame([(1, "abc")]), nothing).first()["lang_pred"] == "und"


def test_language_sample_is_bounded_and_held_out(frame, monkeypatch):
    monkeypatch.setattr(language_id, "ROWS_PER_LANGUAGE", 20)
    rows = [(i, f"doc{i} " + ("x" if i % 9 else "y") * 400, "en" if i % 9 else "fr") for i in range(900)]
    sample = language_id.training_sample(frame(rows), "doc_id", "text", "lang")
    ids = {int(p.split()[0][3:]) for _, p in sample if p.startswith("doc")}
    assert len(ids) <= 80 and not any(brute.held_out(i) for i in ids) and {x for x, _ in sample} == {"en", "fr"}


def test_language_sample_holds_whole_texts_of_all_languages(frame):
    rows = [(i, f"text {i} " + "z" * 3000, f"l{i % 700}") for i in range(1500)]
    sample = language_id.training_sample(frame(rows), "doc_id", "text", "lang")
    learnable = {lang for i, _, lang in rows if not brute.held_out(i)}
    assert {x for x, _ in sample} == learnable and len(learnable) > 512 and all(len(t) > 3000 for _, t in sample)


def test_network_gradients():
    """Against finite differences of the cross entropy."""
    rng = np.random.default_rng(1)
    net = language_id.ByteConvNet(["a", "b", "c"])
    x, y = rng.integers(0, 256, (6, 40)).astype(np.uint8), rng.integers(0, 3, 6)
    params = [*net.tables.values(), net.bias, net.out, net.out_bias]
    for i, p in enumerate(params):
        params[i][...] = p.astype(np.float32)

    def loss():
        features = []
        for w in language_id.WIDTHS:
            span = 40 - w + 1
            features.append(sum(net.tables[w, k].astype(float)[x[:, k : k + span]] for k in range(w)).max(1))
        p = language_id.softmax(np.maximum(np.concatenate(features, 1) + net.bias.astype(float), 0) @ net.out.astype(float) + net.out_bias.astype(float))
        return -np.log(p[np.arange(6), y]).mean() + 0.5e-4 * (net.out.astype(float) ** 2).sum()

    for p, g in zip(params, net._gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], np.float32(1e-3)
        p[at] = old + step
        high, up = loss(), float(p[at])
        p[at] = old - step
        low, down = loss(), float(p[at])
        p[at] = old
        assert abs((high - low) / (up - down) - g[at]) < 2e-3 * max(1, abs(g[at]))


def test_network_tables_give_the_convolution():
    net = language_id.ByteConvNet(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (5, 64)).astype(np.uint8)
    features = []
    for w in language_id.WIDTHS:
        span = 64 - w + 1
        features.append(sum(net.tables[w, k][x[:, k : k + span]] for k in range(w)).max(1))
    want = language_id.softmax(np.maximum(np.concatenate(features, 1) + net.bias, 0) @ net.out + net.out_bias)
    assert np.allclose(net.predict(x, net.paired()), want, atol=1e-5)
    windows, rows, lengths = language_id.windows_of(np.arange(600, dtype=np.uint8), np.array([0, 0, 300, 600]))
    assert rows.tolist() == [1, 1, 2, 2] and lengths.tolist() == [256, 44, 256, 44] and windows[1, 44:].sum() == 0


@needs_tables
def test_quality_separates_labelled_rows(spark):
    from tessella.llm.queries import op3_quality

    rows = op3_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["quality"]: r["share"] for r in rows.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert got[1] > 0.8 and got[0] < 0.2
    share = labels.filter("quality = 1 and toxic = 0").count() / labels.count()
    assert rows.filter("kept").count() == round(share * rows.count())


def test_quality_counts_and_weights(frame, spark):
    rows = [(1, "good good words"), (2, "bad words"), (3, None), (4, ""), (5, "good words"), (5, "good words")]
    df = frame(rows).withColumn("key", F.lit(1)).withColumn("kept", F.lit(1))
    got = {r["doc_id"]: r for r in quality.resample(df, frame([(1,), (5,)], "doc_id long"), 0.5).collect()}
    assert got[3]["n_features"] == 0 and got[3]["log_weight"] == 0 and got[1]["n_features"] == 5 and got[1]["log_weight"] > got[2]["log_weight"]
    total = quality.counts(frame(rows))
    assert total.sum() == sum(len(brute.WORD.findall(t or "")) + max(0, len(brute.WORD.findall(t or "")) - 1) for _, t in rows)
    assert quality.resample(frame([]), frame([], "doc_id long"), 0.5).count() == 0
    assert quality.resample(frame(rows), frame([], "doc_id long"), 1.0).filter("kept").count() == len(rows)


def test_quality_is_importance_resampling(frame, corpus):
    """Weights, keys and kept rows against a plain form over hashed words and word pairs."""
    import xxhash

    rows = [*corpus, (None, "one two"), (1, corpus[4][1])]
    target = {i for i, _ in corpus[:40]}
    got = quality.resample(frame(rows), frame([(i,) for i in target], "doc_id long"), 0.3).collect()

    def grams(text):
        batch = pa.array([text or ""])
        (_, data, offs), = quality.textkit.pieces(batch)
        return quality._grams(quality.textkit.Words(data, offs, fold=True))[0].tolist()

    own = [grams(t) for _, t in rows]
    raw, wanted = np.zeros(2 * quality.BUCKETS), np.zeros(2 * quality.BUCKETS)
    for (i, _), g in zip(rows, own, strict=True):
        np.add.at(raw, g, 1)
        if i in target:
            np.add.at(wanted, g, 1)
    ratio = np.zeros(2 * quality.BUCKETS)
    for part in (slice(0, quality.BUCKETS), slice(quality.BUCKETS, None)):
        scale = wanted[part].sum() / raw[part].sum()
        ratio[part] = np.log((wanted[part] + quality.PRIOR) / (raw[part] * scale + quality.PRIOR))
    weights = sorted((i or 0, round(float(ratio[g].sum()), 2)) for (i, _), g in zip(rows, own, strict=True))
    assert np.allclose([w for _, w in weights], [w for _, w in sorted((r["doc_id"] or 0, r["log_weight"]) for r in got)], atol=0.05)

    def noise(i):
        u = (xxhash.xxh64(np.int64(-1 if i is None else i).tobytes(), seed=xxhash.xxh64(np.int32(1).tobytes(), seed=42).intdigest()).intdigest() % (1 << 52) + 0.5) / (1 << 52)
        return -np.log(-np.log(u))

    assert all(abs(r["key"] - r["log_weight"] - noise(r["doc_id"])) < 1e-6 for r in got)
    bound = sorted((r["key"] for r in got), reverse=True)[round(0.3 * len(rows)) - 1]
    assert all(r["kept"] == (r["key"] >= bound) for r in got)


@pytest.mark.parametrize("gathered", [3, 10_000])
def test_kth_greatest(spark, monkeypatch, gathered):
    monkeypatch.setattr(quality, "GATHERED", gathered)
    values = [float(x) for x in np.random.default_rng(0).normal(size=500)] + [1.5] * 40
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 60, 300, 540, 900):
        assert quality.kth_greatest(df, "x", k) == sorted(values, reverse=True)[min(k, 540) - 1]
    assert quality.kth_greatest(df, "x", 0) is None


def test_extraction_of_unseen_layouts():
    field = html_extraction.trained()
    pages = html_extraction.training_set(200, seed=77)
    right = [field.decode(rows) == labels for rows, labels in pages]
    assert np.mean(right) > 0.95
    a, b = html_pages.labelled_pages(3, 1), html_pages.labelled_pages(3, 1)
    assert a == b


@needs_tables
def test_extraction_is_what_a_plain_reader_finds(spark):
    """The pages of the tables have one layout, whose main text stands in `article`: all of them against Python's own parser."""
    import re
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.parts, self.inside = [], [], False

        def cut(self):
            text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
            self.blocks += [text] if text else []
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.parts.append(" ")
            elif tag not in ("a", "b"):
                self.cut()
            self.inside |= tag == "article"

        def handle_endtag(self, tag):
            if tag not in ("a", "b"):
                self.cut()
            self.inside &= tag != "article"

        def handle_data(self, text):
            if self.inside:
                self.parts.append(text)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r["html"])
        reader.close()
        reader.cut()
        want[r["page_id"]] = "\n\n".join(reader.blocks)
    assert {r["page_id"]: r["text"] for r in html_extraction.extract(pages).collect()} == want and all(want.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy this now.</div>
<article><h1>Head &amp; line</h1><p><b>One   two\n three<br>four.<p>Caf&eacute; &lt;b&gt; <a href="/x">link</a> text that goes on for a while.</p><!-- no --><ul><li>item one</li></ul></article>
<section class="comments"><p>First!</p></section><footer>&copy; me</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, "v", None), (3, "w", ""), (4, "x", "<p>"), (4, "x", "<p>"), (5, "y", "<!-- open"), (6, None, "<article><p>" + "word " * 40_000 + "end.</p>"), (7, "z", "<div <p>a</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("n_chars", F.lit("old"))
    got = {r["page_id"]: r for r in html_extraction.extract(df).collect()}
    assert got[1]["text"] == "Head & line\n\nOne two three four.\n\nCafé <b> link text that goes on for a while.\n\nitem one"
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == got[3]["text"] == got[4]["text"] == got[5]["text"] == ""
    assert got[6]["n_chars"] == 5 * 40_000 + 4
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_chain_marginals():
    field, rng = html_extraction.ChainField(), np.random.default_rng(0)
    field.move, field.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    scores = rng.normal(size=(5, 2))
    paths = np.array(np.meshgrid(*[[0, 1]] * 5, indexing="ij")).reshape(5, -1).T
    weight = np.exp([field.start[p[0]] + scores[np.arange(5), p].sum() + field.move[p[:-1], p[1:]].sum() for p in paths])
    single, pair = field._marginals(scores)
    assert np.allclose(single[:, 1], [(weight * paths[:, i]).sum() / weight.sum() for i in range(5)])
    assert np.allclose(pair[2, 1, 0], (weight * (paths[:, 2] == 1) * (paths[:, 3] == 0)).sum() / weight.sum())
    field.index, field.weight = {str(i): i for i in range(5)}, scores
    assert field.decode([[str(i)] for i in range(5)]) == paths[weight.argmax()].tolist()


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def least_bins(lengths, capacity):
    """A lower bound: long pieces need bins of their own, and what room they leave must hold the rest."""
    best = -(-sum(lengths) // capacity)
    for small in range(1, capacity // 2 + 1):
        alone = sum(x > capacity - small for x in lengths)
        half = [x for x in lengths if capacity / 2 < x <= capacity - small]
        rest = sum(x for x in lengths if small <= x <= capacity / 2)
        best = max(best, alone + len(half) + max(0, -(-(rest - (len(half) * capacity - sum(half))) // capacity)))
    return best


def test_packing(frame, corpus, tokenizer):
    from tokenizers import Tokenizer

    rows = [*corpus, (None, "no id"), (1, "It's <|endoftext|> 3.5 naïve…"), (1, corpus[3][1])]
    capacity = 100
    found = packing.pack(frame(rows).withColumn("offset", F.lit(1)), tokenizer, capacity=capacity).collect()
    want = defaultdict(int)
    for (i, _), e in zip(rows, Tokenizer.from_file(tokenizer).encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        ids = [*e.ids, packing.END_ID]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s : s + capacity], "<u4")
            want[i, p, s, len(part), zlib.crc32(part.tobytes())] += 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in found:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= least_bins([r["length"] for r in found], capacity) * 1.02 + 1
    assert packing.pack(frame([]), tokenizer).count() == 0


def test_patterns_are_full():
    rng = np.random.default_rng(3)
    for capacity, n in ((50, 400), (4096, 3000), (7, 30)):
        sizes = rng.integers(1, capacity + 1, n)
        counts = {int(s): int(c) for s, c in zip(*np.unique(sizes, return_counts=True), strict=True)}
        found = packing.patterns(counts, capacity)
        used = defaultdict(int)
        for times, bin_ in found:
            assert sum(bin_) <= capacity
            for x in bin_:
                used[x] += times
        assert used == counts and len(found) <= len(counts) * 3
        bins = sum(t for t, _ in found)
        big = sum(c for s, c in counts.items() if 2 * s > capacity)
        assert bins <= max(-(-int(sizes.sum()) // capacity), big) * 1.02 + 1
    assert packing.patterns({}, 10) == []


def test_words_of_one_hash_keep_their_ids(monkeypatch, tokenizer):
    """The words' bytes decide, also if all hashes are equal."""
    texts = ["one two one", "three", "", "two\tfour"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts)], names=["doc_id", "text"])
    (want,) = packing._pieces(tokenizer, 4096)(iter([batch]))

    class Alike(packing.textkit.Words):
        def __init__(self, *args, **more):
            super().__init__(*args, **more)
            self.hash = np.zeros_like(self.hash)

    monkeypatch.setattr(packing.textkit, "Words", Alike)
    packing._vocabulary.cache_clear()
    (got,) = packing._pieces(tokenizer, 4096)(iter([batch]))
    assert got.equals(want)
    packing._vocabulary.cache_clear()


def test_runs_have_the_tokenizers_ids(tokenizer):
    """Words are looked up by their runs of letters, digits and marks, with the ids of whole texts."""
    from tokenizers import Tokenizer

    packing._vocabulary.cache_clear()
    parts = ["a", "It", "'S", "l'", "H\u0331", "A\u0301", "\u0130", "\u1e9e", "\u00c0", "\u00de", "\u00df", "\u00ff", "\u00d7", "\u00f7", "\u00b2", "\u00a0", "\u0085", "\u4e2d", "\u00e9\u0301", "7", "42", ".,", "$", "<", "|", "<|ENDOFTEXT|>", "<|endoftext|>", "\x00", "\x01", "\x1c", "\x7f", " ", "\t", "\n", "_", "straSSe"]
    rng = np.random.default_rng(11)
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(0, 30, 600)]
    (out,) = packing._pieces(tokenizer, 4096)(iter([pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], names=["doc_id", "text"])]))
    want = [zlib.crc32(np.array([*e.ids, packing.END_ID], "<u4").tobytes()) for e in Tokenizer.from_file(tokenizer).encode_batch(texts, add_special_tokens=False)]
    assert out.column("ids_crc32").to_pylist() == want
    packing._vocabulary.cache_clear()
    text = "Word word, WORD. (word)12 1 2 \u00dcber! \u00fcber"
    list(packing._pieces(tokenizer, 4096)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])])))
    assert set(packing._vocabulary(tokenizer).place) == {x.encode() for x in ("word", ",", ".", "(", ")", "1", "2", "\u00fcber", "!")}
    packing._vocabulary.cache_clear()


def test_word_cache_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    packing._vocabulary.cache_clear()
    texts = ["a b c d e", "c d x", "<|startoftext|> a", "y<|endoftext|>z", "", "q \x01 r", "s\x01t u"]
    for text, n in zip(texts, (6, 4, 3, 4, 1, 4, 5), strict=True):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
        (out,) = packing._pieces(tokenizer, 4096)(iter([batch]))
        assert out.column("length").to_pylist() == [n]
        assert len(packing._vocabulary(tokenizer).place) <= 7
    packing._vocabulary.cache_clear()


def test_blocks_after_an_open_head_and_a_self_closed_svg():
    """Text is kept where the head's end is left out, and after an svg without content."""
    texts = lambda page: [b.text for b in html_extraction.blocks(page)]
    assert texts("<html><head><meta charset=utf-8><title>T</title><p>One <b>two</b></p><p>three") == ["One two", "three"]
    assert texts("<head><title>T</title> One <p>two") == ["One", "two"]
    assert texts("<html><head><title>T</title> </head> <body><p>One") == ["One"]
    assert texts("<p>One</p><svg viewBox='0 0 1 1' /><p>two</p>") == ["One", "two"]
    assert texts('<p>One</p><svg/><p>two <svg class="/>"><text>no</text></svg>three</p>') == ["One", "two three"]


def test_blocks_of_deep_and_broken_pages_take_linear_time():
    import time

    n = 20_000
    pages = ["<div>x" * n, '<a "> x' * n, "<a " * n, "<b>" * n + "</i>" * n, "<div>" * n + "<body>" * n, "".join(f"<x{i} class='ad{i}'>t" for i in range(n)), "<b><i>" * n + "x</b></i>" * n]
    began = time.process_time()
    counts = [len(html_extraction.blocks(p)) for p in pages]
    assert time.process_time() - began < 20 and counts[0] == n and counts[5] == n


def test_tags_end_behind_quotes():
    texts = lambda page: [b.text for b in html_extraction.blocks(page)]
    assert texts('<p title="a > b">one</p><p title=\'x">\'>two</p>') == ["one", "two"]
    assert texts('<p title="open>one</p>two') == ["one", "two"] and texts("a < b <c") == ["a < b <c"] and texts("1 <2> 3") == ["1 <2> 3"]
    assert texts("<script>if (a<b) '</p>'</script >x<!DOCTYPE y>") == ["x"] and texts("<b>one <i>two</b> three</i><p>four") == ["one two three", "four"]


def test_word_cache_is_small(monkeypatch, tokenizer):
    """A remembered word takes less than 100 bytes with its ids; words are forgotten beyond CACHE_BYTES."""
    import tracemalloc

    def pieces(text):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
        return [x.column("ids_crc32").to_pylist() for x in packing._pieces(tokenizer, 4096)(iter([batch]))]

    letters = [chr(97 + i) for i in range(26)]
    texts = [" ".join(f"{a}{b}{c}{d}" for b in letters for c in letters for d in letters) for a in "qz"]
    packing._vocabulary.cache_clear()
    pieces("a")
    tracemalloc.start()
    want = [pieces(x) for x in texts]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    place = packing._vocabulary(tokenizer).place
    assert len(place) == 2 * 26**3 + 1 and held < 100 * len(place)
    monkeypatch.setattr(packing, "CACHE_BYTES", 1000)
    packing._vocabulary.cache_clear()
    assert [pieces(x) for x in texts] == want and len(packing._vocabulary(tokenizer).place) == 26**3
    packing._vocabulary.cache_clear()


def test_remembered_words_of_one_hash_keep_their_ids(monkeypatch, tokenizer):
    """A word is not taken for one of another batch that has its hash, whatever their lengths."""
    batches = [pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], names=["doc_id", "text"]) for t in ("one", "two", "three one", "two", "one", "it\u0301s one", "\u4e2d")]
    packing._vocabulary.cache_clear()
    want = list(packing._pieces(tokenizer, 4096)(iter(batches)))

    class Alike(packing.textkit.Words):
        def __init__(self, *args, **more):
            super().__init__(*args, **more)
            self.hash = np.zeros_like(self.hash)

    monkeypatch.setattr(packing.textkit, "Words", Alike)
    packing._vocabulary.cache_clear()
    assert list(packing._pieces(tokenizer, 4096)(iter(batches))) == want
    packing._vocabulary.cache_clear()


def test_packing_writes_few_files(frame, tokenizer, spark):
    """Places are given by as many tasks as blocks or cores, not by one for each shuffle partition."""
    adaptive, partitions = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        found = packing.pack(frame([(i, f"word {i}" + " more" * (i % 7)) for i in range(300)]), tokenizer)
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and found.count() == 300
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
