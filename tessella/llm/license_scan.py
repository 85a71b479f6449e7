"""License recognition by sentence rules. DataFrame functions only.

A text is normalised to lower-case ASCII letters and digits and cut into
sentences: after . ! ? : ; before white space, and at lines without letters and
digits. Any other line end, with the signs of a comment around it, may be white
space or the end of a sentence: a known licence sentence is found wrapped over
lines, and on lines of its own. Known sentences are mapped to identifiers, where
two overlap the one that starts first, then the longer. The identifiers, in text order,
form a sequence; rules are tried in their order, and a rule whose identifier
sequence occurs in it names its licence and uses those identifiers up.

Everything is one projection over the text: no shuffle, no join, and a text
without any of KEYS (each known sentence holds one) is not cut at all.

Defined cases: null or empty text has no sentence and no licence; texts of any
length are read whole; repeated rows get equal results; of rules that name one
licence the first that fits counts; an empty table gives an empty result; other columns are not
looked at. The SQL cuts at every line end and only knows sentences on one
line; on texts without wrapped sentences the two are equal.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Sentences of public licences, by identifier.
SENTENCES: dict[str, list[str]] = {
    "apache-short": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache-compliance": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit-short": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "bsd-short": ["Licensed under the BSD License.", "Released under the BSD License.", "BSD License"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GPLv3."],
    "gpl2-short": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-copy": ["You should have received a copy of the GNU General Public License along with this program."],
    "agpl-short": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "lgpl-short": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "mpl-short": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0.", "This work is in the public domain."],
    "gpl-redistribute": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "gpl2-redistribute": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."],
    "lgpl-redistribute": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "lgpl3-free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-free": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "later-2": ["either version 2 of the License, or (at your option) any later version."],
    "later-2-1": ["either version 2.1 of the License, or (at your option) any later version."],
    "later-3": ["either version 3 of the License, or (at your option) any later version."],
    "bsd-style": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "bsd-warranty": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "mpl-incompatible": ["This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-short": ["Distributed under the Boost Software License, Version 1.0."],
    "epl2-short": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "apache-contributed": ["Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."],
}
#: SPDX identifiers that a line "SPDX-License-Identifier: ..." may name.
SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Unlicense Zlib BSL-1.0 EPL-2.0".split()
SENTENCES |= {f"spdx-{x.lower()}": [f"SPDX-License-Identifier: {x}"] for x in SPDX}
#: Fixed values: (licence, identifiers in order); earlier rules win over later ones.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-short", "mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-short", "apache-compliance", "apache-copy", "apache-basis", "apache-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl-redistribute", "later-2", "gpl-warranty", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl-redistribute", "later-2"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "later-3"]),
    ("GPL-2.0-only", ["gpl2-redistribute"]),
    ("LGPL-2.1-or-later", ["lgpl-redistribute", "later-2-1"]),
    ("LGPL-3.0-or-later", ["lgpl-redistribute", "later-3"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("Apache-2.0", ["apache-contributed", "apache-short"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-short"]),
    ("MIT", ["mit-short"]),
    ("BSD", ["bsd-short"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-2.0", ["gpl2-short"]),
    ("AGPL-3.0", ["agpl-short"]),
    ("LGPL-3.0", ["lgpl-short"]),
    ("MPL-2.0", ["mpl-short"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC0-1.0", ["cc0"]),
    ("BSD", ["bsd-style"]),
    ("MPL-2.0-no-copyleft-exception", ["mpl-incompatible"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost-short"]),
    ("EPL-2.0", ["epl2-short"]),
]
RULES += [(x, [f"spdx-{x.lower()}"]) for x in SPDX]
#: Words of which every known sentence has one.
KEYS = ("licen", "permission", "permitted", "redistribut", "warrant", "public domain", "copyright")
_CUT, _FOLD = r"([.!?:;])[ \t]+", "[^a-z0-9]+"
#: Fixed value: what names a licence by its identifier; its colon ends no sentence.
_TAG = "license-identifier:"
#: Marks in a normalised text: the end of a sentence; a line end is "\n".
_END = "\x01"


def normal(sentence: str) -> str:
    return re.sub(_FOLD, " ", sentence.lower()).strip()


def _table(sentences: dict[str, list[str]]) -> dict[str, str]:
    """Normalised sentence to identifier. A form that the cut divides ("v. 2.0") stands for its longest part."""
    found: dict[str, str] = {}
    for name, forms in sentences.items():
        for form in forms:
            form = form.lower().replace(_TAG, _TAG[:-1])
            part = max((normal(x) for x in re.sub(_CUT, r"\1\n", form).split("\n")), key=len)
            if not any(k in part for k in KEYS):
                raise ValueError(f"no key word in {form!r}")
            found[part] = name
    return found


def _marked(text: Column) -> Column:
    """The normalised text, words parted by one space or mark, between two marks."""
    text = F.regexp_replace(F.replace(F.lower(text), F.lit(_TAG), F.lit(_TAG[:-1])), r"\n[^a-z0-9\n]+", "\n")
    text = F.regexp_replace(text, r"[.!?:;](?:[ \t]+|[ \t\r]*\n)", _END)
    text = F.regexp_replace(text, rf"[^a-z0-9\n{_END}]+", " ")
    text = F.regexp_replace(text, rf"{_END}[ \n{_END}]*", _END)
    text = F.regexp_replace(text, r"\n ?\n[ \n]*", _END)
    return F.concat(F.lit(_END), F.trim(F.regexp_replace(text, rf" ?([\n{_END}]) ?", "$1")), F.lit(_END))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """(doc_id, n_sentences, identifiers, licenses): recognised sentences, their identifiers in text order and the licences in rule order, joined by commas."""
    known = _table(sentences)
    keyed = F.coalesce(F.col(text_col).rlike("(?i)" + "|".join(KEYS).replace(" ", "[^a-z0-9]+")), F.lit(False))
    spots = "|".join(sorted(known, key=len, reverse=True)).replace(" ", r"[ \n]")
    hits = F.regexp_extract_all(_marked(F.col(text_col)), F.lit(rf"(?<=[\n{_END}])(?:{spots})(?=[\n{_END}])"), F.lit(0))
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ids = F.transform(F.when(keyed, hits).otherwise(F.array().cast("array<string>")), lambda s: F.element_at(pairs, F.translate(s, "\n", " ")))
    state = F.struct(F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|")).alias("left"), F.lit("").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["sequence"]) & ~F.contains(F.concat(acc["found"], F.lit(",")), F.concat(F.lit(","), rule["name"], F.lit(",")))
        used = F.when(F.contains(acc["left"], rule["sequence"]), F.replace(acc["left"], rule["sequence"], F.lit("|"))).otherwise(acc["left"])
        return F.struct(used.alias("left"), F.when(hit, F.concat(acc["found"], F.lit(","), rule["name"])).otherwise(acc["found"]).alias("found"))

    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "|".join(seq) + "|").alias("sequence")) for name, seq in rules])
    found = F.aggregate(listed, state, step, lambda acc: F.substring(acc["found"], F.lit(2), F.length(acc["found"])))
    return docs.select(F.col(id_col).alias("doc_id"), ids.alias("ids")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("identifiers"),
        F.when(F.size("ids") > 0, found).otherwise("").alias("licenses"),
    )


def oracle_sql(sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> str:
    """The same for DuckDB, over documents."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in _table(sentences).items())
    steps, last = [], "seq"
    for i, (name, sequence) in enumerate(rules):
        seq = "|" + "|".join(sequence) + "|"
        steps.append(
            f"r{i} AS (SELECT doc_id, n, ids, replace(l, '{seq}', '|') AS l, "
            f"CASE WHEN contains(l, '{seq}') AND NOT contains(f || ',', ',{name},') THEN f || ',{name}' ELSE f END AS f FROM {last})"
        )
        last = f"r{i}"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
parts AS (SELECT row, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (
  SELECT row, string_split(regexp_replace(replace(lower(text), '{_TAG}', '{_TAG[:-1]}'), '([.!?:;])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS p FROM docs)),
hits AS (SELECT row, i, id FROM parts JOIN known ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))),
per AS (SELECT row, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids, string_agg(id, '|' ORDER BY i) AS seq FROM hits GROUP BY row),
seq AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, '|' || coalesce(seq, '') || '|' AS l, '' AS f FROM docs LEFT JOIN per USING (row)),
{", ".join(steps)}
SELECT doc_id, n AS n_sentences, ids AS identifiers, substr(f, 2) AS licenses FROM {last}"""
