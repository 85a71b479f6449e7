import random

import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from tessella.llm import decontamination, fingerprints, license_scan, url_filter


def test_licenses(frame):
    s = license_scan.SENTENCES
    full_mit = "\n".join(f[0] for f in (s["mit-short"], s["mit-grant"], s["mit-notice"], s["mit-warranty"]))
    texts = [None, "", "no licence here", "Intro text. Released under the MIT License. More text.", full_mit, full_mit + "\nLicensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
             s["mit-notice"][0] + "\n" + s["mit-grant"][0], "x " * 30_000 + "\nThis work is licensed under the GNU General Public License, version 3.", "RELEASED UNDER THE MIT LICENSE!", "permission warranty license"]
    rows = list(enumerate(texts)) + [(None, "Released under the MIT License.")]
    df = frame(rows).withColumn("ids", F.lit(1)).withColumn("licenses", F.lit(2))
    got = {r["doc_id"]: (r["n_sentences"], r["identifiers"], r["licenses"]) for r in license_scan.licenses(df).collect()}
    for i, t in rows:
        ids, names = brute.licenses(t, license_scan.SENTENCES, license_scan.RULES)
        assert got[i] == (len(ids), ",".join(ids), ",".join(names)), t
    assert got[4][2] == "MIT" and got[5][2] == "MIT,CC-BY-NC-4.0" and got[7][2] == ""
    assert license_scan.licenses(frame([])).count() == 0


def test_licenses_of_wrapped_texts(frame):
    """Sentences that are wrapped over lines, plain and in comments; a blank line or the end of a sentence parts."""
    import textwrap

    s = license_scan.SENTENCES
    wrapped = lambda keys, width=72: "\n\n".join("\n".join(textwrap.wrap(s[k][0], width)) for k in keys)
    comment = lambda text, sign: "\n".join((sign + " " + line).rstrip() for line in text.split("\n"))
    mit = "MIT License\n\nCopyright (c) 2020 X\n\n" + wrapped(["mit-grant", "mit-notice", "mit-warranty"])
    bsd = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]
    listed = "\n".join(textwrap.fill(str(i) + ". " + s[k][0], 60, subsequent_indent="   ") for i, k in enumerate(bsd[1:], 1))
    gpl = wrapped(["gpl-free", "gpl-warranty", "gpl-copy"])
    apache = "\n".join(textwrap.wrap(s["apache-short"][2], 79)) + "\n" + "\n".join(s[k][0] for k in ("apache-compliance", "apache-copy")) + "\n\n    http://example.org/2.0\n\n" + wrapped(["apache-basis", "apache-see"], 50).replace("\n\n", "\n")
    cases = [
        (mit, "MIT", 4), (comment(mit, "#"), "MIT", 4), (mit.replace("\n", "\r\n"), "MIT", 4), (wrapped(["mit-grant", "mit-notice"], 40), "MIT", 2),
        (comment(wrapped(bsd), " *"), "BSD-3-Clause", 4), (wrapped(bsd[:1], 30) + "\n" + listed, "BSD-3-Clause", 4), (comment(wrapped(bsd[:3]), "//"), "BSD-2-Clause", 3),
        ("/*\n" + comment(wrapped(["isc-grant"]), " *") + "\n */", "ISC", 1), (gpl, "GPL-3.0-or-later", 3), (comment(gpl, ";;"), "GPL-3.0-or-later", 3),
        (comment(apache, "#"), "Apache-2.0", 5), ("This work is in the public\ndomain.", "CC0-1.0", 1), ("MIT License\nThis project is licensed under the\nMIT License.", "MIT", 2),
        ("Released under\n\nthe MIT License.", "", 0), ("Released under.\nthe MIT License.", "", 0), ("xReleased under the\nMIT Licensed.", "", 0),
    ]
    got = {r["doc_id"]: (r["licenses"], r["n_sentences"]) for r in license_scan.licenses(frame([(i, c[0]) for i, c in enumerate(cases)])).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_licenses_by_identifier_and_older_notices(frame):
    gpl2 = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n"
    cases = [
        ("# SPDX-License-Identifier: GPL-2.0-or-later\nimport x", "GPL-2.0-or-later"), ("/* SPDX-License-Identifier: MIT */", "MIT"), ("// SPDX-License-Identifier: BSD-3-Clause-Clear", ""),
        (gpl2, "GPL-2.0-or-later"), (gpl2.replace("General", "Lesser General").replace("version 2 ", "version 2.1 "), "LGPL-2.1-or-later"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "BSD"),
        ("x " * 400_000 + "\nDistributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("MIT License\n\nMIT License", "MIT"),
    ]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.licenses(frame([(i, c[0]) for i, c in enumerate(cases)])).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


ITEMS = "item_id long, text string"


def test_decontamination(frame, writer):
    items = [(i, " ".join(writer.words(writer.r.randint(16, 50)))) for i in range(12)] + [(50, "two words"), (51, None), (52, "..."), (53, " ".join(writer.words(30)))]
    items.append((60, items[0][1]))
    docs = [(i, " ".join(writer.words(80))) for i in range(40)]
    for i in range(12):
        words = items[i][1].split()
        docs.append((100 + i, " ".join([*writer.words(i * 3), *words, *writer.words(20)])))
        docs.append((200 + i, " ".join([*writer.words(7), *writer.edited(words, 0.03), *writer.words(9)]).upper()))
        docs.append((300 + i, " ".join([*writer.words(5), *words[: len(words) // 2]])))
        half = len(words) // 2
        docs.append((400 + i, " ".join([*writer.words(6), *words[half:], *words[:half], *writer.words(i)])))
        docs.append((500 + i, " ".join([*writer.words(4), *words[half:], writer.words(1)[0], *words[:half]])))
        docs.append((600 + i, " ".join(words[2:])))
    docs += [(-1, items[5][1]), (None, items[5][1]), (700, " ".join([items[0][1]] * 40))]
    docs += [(900, None), (901, ""), (902, "It is two words, here"), (903, items[3][1] + " " + items[3][1])]
    found = decontamination.contaminated(frame(docs), frame(items, ITEMS)).collect()
    got = {(r["doc_id"], r["item_id"]): (r["common"], r["total"]) for r in found}
    assert got == brute.contaminated(docs, items, 5, 80) and len(found) == len(got)
    assert {(100 + i, i) for i in range(12)} <= set(got) and (902, 50) in got and not any(300 <= (d or 0) < 400 for d, _ in got)
    assert len({d for d, _ in got if 400 <= (d or 0) < 500}) > 1 and {(-1, 5), (None, 5)} <= set(got)


def test_decontamination_sees_swapped_halves(frame, writer):
    """Most shingles are there, none of them in the item's place."""
    words = writer.words(80)
    swapped = " ".join(words[40:] + words[:40])
    far = " ".join(words[60:] + words[40:60] + words[20:40] + words[:20])  # 64 of 76 shingles: below
    got = decontamination.contaminated(frame([(1, swapped), (2, far), (3, "x y z " + swapped + " end")]), frame([(7, " ".join(words))], ITEMS)).collect()
    assert {(r["doc_id"], r["start"], r["common"], r["total"]) for r in got} == {(1, 0, 72, 80), (3, 3, 72, 80)}


def test_decontamination_of_long_texts(frame, writer):
    item = writer.words(40)
    text = " ".join([*writer.words(60_000), *item, *writer.words(5), *item])
    got = decontamination.contaminated(frame([(1, text)]), frame([(7, " ".join(item))], ITEMS)).collect()
    assert [(r["start"], r["common"], r["total"]) for r in got] == [(60_000, 36, 36)]


def test_packed_counts_give_the_same_fingerprint(spark):
    rng = random.Random(5)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(1, 90))],) for _ in range(60)] + [([3, 3, -1, -1],), ([],)]
    df = spark.createDataFrame(rows, "g array<long>")
    assert df.filter(decontamination.packed_simhash(F.col("g")) != decontamination.simhash(F.col("g"))).count() == 0


def test_decontamination_odd_rows(frame):
    text = "a b c d e f g h"
    df = frame([(1, text), (1, text), (None, text), (2, "z")]).withColumn("item_id", F.lit(3)).withColumn("start", F.lit(3))
    got = decontamination.contaminated(df, frame([(7, text.upper())], ITEMS)).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["start"], r["common"], r["total"]) for r in got), key=repr) == [(1, 7, 0, 4, 4), (None, 7, 0, 4, 4)]
    assert decontamination.contaminated(df, frame([], ITEMS)).count() == 0
    assert decontamination.contaminated(frame([]), frame([(7, text)], ITEMS)).count() == 0


def test_decontamination_without_broadcast(frame, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    text = " ".join(f"w{i}" for i in range(20))
    assert decontamination.contaminated(frame([(1, "q " + text)]), frame([(7, text)], ITEMS)).count() == 1


def test_blocks_hold_all_pairs_in_radius(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontamination.RADIUS):
            b ^= 1 << bit
        sign = lambda x: x - (1 << 64) if x >> 63 else x
        rows.append((sign(a), sign(b)))
    table = decontamination.listed(spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, item_print long"))
    other = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "i int, b long").select("i", F.explode(decontamination.blocks(F.col("b"))).alias("x")).select("i", "x.*")
    assert table.join(other, ["i", "number", "value"]).select("i").distinct().count() == len(rows)
    assert sum(own + 1 for _, _, own in decontamination.allotted(decontamination.RADIUS)) == decontamination.RADIUS + 1


def test_fingerprints(frame, corpus):
    found = fingerprints.edited_fingerprints(frame(corpus)).collect()
    want = brute.edited(corpus)
    assert len(found) == len(corpus)
    same = {}
    for i, t in corpus:
        same.setdefault(brute.canonical(t), []).append(i)
    texts = dict(corpus)
    for r in found:
        n, sha, new, following = want[r["doc_id"]]
        own = texts[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (brute.fingerprint(own), brute.fingerprint(new))
        assert r["near_edited"] == float(brute.canonical(own) == brute.canonical(new)) and r["near_next"] == float(brute.canonical(own) == brute.canonical(following))
        group = same[brute.canonical(own)]
        assert (r["first_doc_id"], r["n_copies"]) == (min(group), len(group))


def test_fingerprints_in_many_ranges(spark, frame, corpus):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.edited_fingerprints(frame(corpus)).collect()}
            assert got == {i: v[1] for i, v in brute.edited(corpus).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_fingerprints_of_colliding_texts(spark, frame, monkeypatch):
    """Bytes decide inside a bucket: with all fingerprints equal the groups are still those of equal texts."""
    monkeypatch.setattr(fingerprints, "fingerprint", lambda canon: F.substring(canon, 1, 0))
    rows = [(1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, " B "), (5, " B ")]
    got = sorted((r["doc_id"], r["first_doc_id"], r["n_copies"]) for r in fingerprints.fingerprints(frame(rows)).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (3, 3, 3), (4, 4, 1), (5, 3, 3), (5, 3, 3)]


def test_fingerprints_fold(frame):
    rows = [(1, "Ａ  ﬁ\u00a0x\n"), (2, "a fi X"), (3, "é"), (4, "e\u0301"), (5, None), (6, "")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame(rows)).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[3]["fingerprint"] == got[4]["fingerprint"] != got[1]["fingerprint"]
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[2]["first_doc_id"] == 1 and got[6]["n_copies"] == 2


def test_fingerprints_odd_rows(frame):
    rows = [(4, "bbb"), (4, "aaa"), (None, "nnn"), (9, "xyz"), (9, "xyz"), (9, "xyz"), (-1, None)]
    df = frame(rows).withColumn("part", F.lit(1)).withColumn("next_text", F.lit("q")).withColumn("h1", F.lit("q"))
    got = fingerprints.edited_fingerprints(df).collect()
    assert len(got) == 7 and sorted(r["near_next"] for r in got if r["doc_id"] == 9) == [0.0, 1.0, 1.0]
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["edited_sha256"])
    # ids descend, those without one come last and are followed by the first; rows of one id stand in either order
    assert by[None] == {sha("nnx")} and by[-1] == {sha("")} and by[9] in ({sha("xyx"), sha("xya")}, {sha("xyx"), sha("xyb")})
    assert by[4] in ({sha("aab"), sha("bb")}, {sha("bba"), sha("aa")})
    assert {r["n_copies"] for r in got if r["doc_id"] == 9} == {3}
    one = fingerprints.edited_fingerprints(frame([(1, "abcdef")])).first()
    assert one["n_chars"] == 6 and one["near_next"] == 1.0 and one["edited_sha256"] == sha("abcdab")
    assert fingerprints.edited_fingerprints(frame([])).count() == 0 and fingerprints.fingerprints(frame([])).count() == 0


def test_fingerprints_fold_case_and_long_texts(frame):
    rows = [(1, "Straße"), (2, "STRASSE"), (3, "οδος"), (4, "ΟΔΟΣ"), (5, "w " * 300_000), (6, "W\n" * 300_000)]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(frame(rows)).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[5] == got[6] and len(set(got.values())) == 3


URLS = [
    ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/a", "x.www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("https://www.example.com/fr/", "www.example.com", "/fr/", "com/", "allow"),
    ("ftp://notexample.com", "notexample.com", "", None, None),
    ("http://s.net/es/1", "s.net", "/es/1", "net/es/", "block"),
    ("http://s.net/en/1", "s.net", "/en/1", None, None),
    ("http://s.net?x=://a/b", "s.net", "", None, None),
    ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
]


def test_url_rules(spark):
    from tessella.llm.queries import URL_RULES

    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, none, URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), r
    assert url_filter.judge(pages.limit(0), none, URL_RULES).count() == 0


def test_url_repeats_and_long_urls(spark):
    """Each outcome counts, repeated ones too; a repeated page gives repeated rows; a url is read whole."""
    long = "http://" + "a." * 50_000 + "org/" + "p" * 100_000
    pages = spark.createDataFrame([(1, "http://bad.org/x"), (1, "http://bad.org/x"), (2, long), (None, "http://bad.org/y"), (3, None)], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1)] * 30 + [(2, 0)] * 20 + [(9, 1), (None, 1), (3, None)], "page_id long, bad int")
    got = sorted((tuple(r) for r in url_filter.judge(pages, outcomes, []).select("page_id", "verdict", "host_outcomes", "host_bad").collect()), key=repr)
    assert got == sorted([(1, "block", 60, 60), (1, "block", 60, 60), (2, "allow", 20, 0), (None, "block", 60, 60), (3, "allow", 0, 0)], key=repr)


def test_reputation(spark):
    rows = [("bad.example.org", 1)] * 60 + [("good.example.org", 0)] * 60 + [("rare.example.org", 1)] * 2 + [("x.other.co.uk", 0)] * 30 + [("", 0), ("q", None)]
    got = {r["host"]: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.example.org"]["bound"] > url_filter.LIMIT > got["rare.example.org"]["bound"] > got["good.example.org"]["bound"]
    # a rare host is shrunk towards its domain
    assert got["good.example.org"]["mean"] < got["rare.example.org"]["mean"] < 1 and "q" not in got
    found = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.y.org",), ("org",)], "h string").select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()
    names = [("10.0.0.1:80",), ("me@www.a.com.cn:8080",), ("[::1]:9",), ("co.uk",), ("x.github.io",)]
    named = spark.createDataFrame(names, "h string").select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in named] == [("10.0.0.1", "10.0.0.1"), ("a.com.cn", "com.cn"), ("[::1]", "[::1]"), ("co.uk", "co.uk"), ("github.io", "io")]
    assert [tuple(r) for r in found] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("y.org", "org"), ("org", "org")]


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_near_dedup", "op5_decontamination", "op6_substring_dedup", "op9_url_filter"])
def test_sql_agrees(spark, name):
    import os

    import duckdb

    from tessella.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    want = sorted(rel.fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, sf).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["op1_license_scan", "op5_decontamination", "op9_url_filter", "op10_fingerprints"])
def test_no_python_on_the_executors(spark, name):
    import os
    import re

    from tessella.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
