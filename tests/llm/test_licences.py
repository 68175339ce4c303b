"""Licence scans with tables of any size, against a search word by word, and texts as they are found in the wild."""

import random
import re
from collections import Counter

import pytest

from strandlake.llm import licences


def plain(t):
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).strip()


def brute(text, sentences, rules):
    parts = [p for p in map(plain, re.split(r"[.!?;:]+(?:[ \t\n\r\f\x0b]+|\Z)|[\n\r]+", text or "")) if p]
    known = {}
    for i, s in sentences:
        known[plain(s)] = min(i, known.get(plain(s), i))
    found = []
    for a in range(len(parts)):
        for b in range(a, len(parts)):
            run = " ".join(parts[a : b + 1])
            if run in known:
                found.append((a, b, len(run), known[run]))

    def uncovered(ms):
        return [m for m in ms if not any(o[2] > m[2] and o[0] <= m[1] and o[1] >= m[0] for o in ms)]

    ids = [i for _, _, _, i in sorted(uncovered(found), key=lambda m: (m[0], m[1], m[3]))]
    named = {(a, a + len(own) - 1, len(own), name) for name, own in rules for a in range(len(ids)) if own and ids[a : a + len(own)] == list(own)}
    return len(parts), len(ids), ",".join(ids), ",".join(sorted({m[3] for m in uncovered(list(named))}))


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_random_tables(spark, broadcast):
    r = random.Random(broadcast)
    words = ["a", "b", "c", "the", "Mit", "of"]
    phrase = lambda n: " ".join(r.choices(words, k=n))
    sentences = [(f"s{r.randint(0, 12)}", phrase(r.randint(1, 5)) + r.choice(["", "!", " ."])) for _ in range(30)] + [("s1", " ?"), ("s2", "")]
    rules = [(f"L{r.randint(0, 6)}", [f"s{r.randint(0, 12)}" for _ in range(r.randint(1, 3))]) for _ in range(25)] + [("none", [])]
    texts = [None, "", " . ", *["".join(phrase(r.randint(1, 3)) + r.choice([". ", "\n", " ", "; ", ".x "]) for _ in range(r.randint(0, 25))) for _ in range(60)]]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (5, texts[6])]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, ids string, n int, h int").repartition(3)
    tables = spark.createDataFrame(sentences, "id string, sentence string"), spark.createDataFrame(rules, "license string, ids array<string>")
    got = Counter(map(tuple, licences.license_scan(docs, *tables, broadcast=broadcast).collect()))
    assert got == Counter((i, *brute(t, sentences, rules)) for i, t in rows) and sum(bool(x[-1]) for x in got) > 20
    for none in ((tables[0].limit(0), tables[1]), (tables[0], tables[1].limit(0))):
        assert {x[-1] for x in licences.license_scan(docs, *none).collect()} == {""}


def test_tables_do_not_grow_the_plan(spark):
    sentences = spark.range(10_000).selectExpr("concat('s', id) AS id", "concat('sentence number ', id, ' of a long list of known ones') AS sentence")
    rules = spark.range(10_000).selectExpr("concat('licence ', id) AS license", "CASE WHEN id % 2 = 0 THEN array(concat('s', id)) ELSE array(concat('s', id), concat('s', id + 1)) END AS ids")
    docs = spark.createDataFrame([(i, f"Intro.\nSentence number {7 * i}, of a long list\nof known ones. Sentence number {7 * i + 1} of a long list of known ones!\nEnd") for i in range(300)], "doc_id long, text string")
    out = licences.license_scan(docs, sentences, rules)
    want = {i: f"licence {7 * i}" if 7 * i % 2 else f"licence {7 * i},{'' if (7 * i + 1) % 2 else f'licence {7 * i + 1}'}".rstrip(",") for i in range(300)}
    assert {r.doc_id: r.licenses for r in out.collect()} == want
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_texts_in_the_wild(spark):
    cases = {
        "// SPDX-License-Identifier: GPL-2.0-only\nint main;": "gpl-2.0",
        "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)": "bsl-1.0",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy": "gpl-3.0",
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS": "apache-2.0",
        "This project uses the MIT License.": "mit",
        "# Use of this source code is governed by a BSD-style license that can be\n# found in the LICENSE file.": "bsd",
        "SPDX-License-Identifier: Apache-2.0\n\nReleased under the MIT License.": "apache-2.0,mit",
        "The MIT license is short. We discuss what the gnu project did in version 3 of it.": "",
        "I was licensed under the old rules, and the license\nwas lost": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licences.license_scan(docs).collect()} == dict(enumerate(cases.values()))


def test_one_licence_line_many_times(spark):
    text = "Released under the MIT License.\n" * 20_000
    got = licences.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_sentences, got.n_known, got.licenses) == (20_000, 20_000, "mit")
