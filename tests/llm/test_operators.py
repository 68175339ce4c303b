"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import io
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandlake.llm import decontaminate, licences, line_dedup, near_dedup, pack, pii, quality, syncmers, token_counts, token_files
from strandlake.llm.bpe import Encoder
from strandlake.llm.components import connected_components

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "Hello  World\n\nsecond line é ü ßx — “quoted” 漢字 かな"), (2, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "Hello  World\n\nsecond line é ü ßx — “quoted” 漢字 かな"),
    (7, "<|endoftext|> a ▁▁b <s>x</s> it's WE'LL 12.5 İstanbul ŉ x\x1cy\x00z"), (8, "word " * 3000 + "end"), (9, "x" * 5000), (10, "mail a@b.c_d@e.f.g and +1 (017) 555-7713 and 1.2.3.4 4111 1111 1111 1111"), (11, "é́    ﬁ ½ 𝒳 🙂🙂"),
]


def frame(spark, rows, extra=True):
    docs = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}" if (i or 0) % 5 else None, len(t or ""), "clash", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n long, start int".replace("n long, start int", "key string, start int"))
    return docs if extra else docs.select("doc_id", "text")


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return [*ODD, *[(i + 1000, t) for i, t in rows]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(5, "doc_id")


def empty(docs):
    return docs.filter("doc_id < -1")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, ids = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("broadcast", [(500_000, 100_000), (0, 0)])
def test_decontamination(spark, docs, corpus, broadcast):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(500, "Hello, world second LINE"), (501, None), (502, "..."), (503, "one"), (504, "word " * 40), (505, "é ü ßx")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {r.doc_id: tuple(r)[1:6] for r in decontaminate.decontamination_report(docs, table, broadcast=broadcast).collect()}
    assert got == brute_contamination(corpus, items)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, table).collect()}
    assert kept == {d for d, v in got.items() if not v[4]}
    assert decontaminate.decontamination_report(empty(docs), table).count() == 0
    assert not decontaminate.decontamination_report(docs, table.limit(0)).filter("n_hit > 0").count()
    twice = decontaminate.decontamination_report(docs.unionByName(docs), table, broadcast=broadcast).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in twice} == got and len(twice) == len(got)


def test_documents_are_read_once(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    plans = [decontaminate.decontamination_report(docs, x)._jdf.queryExecution().executedPlan().toString() for x in (items.limit(40), items)]
    assert [p.count(f"{SF}/documents.parquet") for p in plans] == [1, 1]


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.quality_scores(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    rank = got["score"].rank()
    pos = got["quality"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.9 and (got["predicted"] == pos).mean() > 0.9


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(docs, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert quality.quality_scores(empty(docs), labels).count() == 0
    assert quality.keep_quality(docs, labels.limit(0)).columns == docs.columns


def brute_anchors(text, k=5, s=2):
    """(hash, place) of each closed syncmer, by its definition."""
    import struct

    import regex
    import xxhash

    def signed(h):
        return h - 2**64 if h >= 2**63 else h

    def folded(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
        return signed(h)

    tokens = [signed(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), seed=42)) for t in regex.findall(r"\p{Ideographic}|[^ \t\n\x0b\f\r\p{Ideographic}]{1,16}", text)]
    if len(tokens) < k:
        return [(folded(tokens) & (2**48 - 1), 0)] if tokens else []
    out = []
    for i in range(len(tokens) - k + 1):
        inner = [folded(tokens[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((folded(tokens[i : i + k]) & (2**48 - 1), i))
    return out


def brute_fingerprint(text):
    found = brute_anchors(text)
    return [f"{h:012x}{i - j if n else 0}" for n, ((h, i), (_, j)) in enumerate(zip(found, found[:1] + found))]


def brute_likeness(a, b):
    x, y = set(a), set(b)
    return 1.0 if a == b else len(x & y) / len(x | y)


def test_syncmers(spark, docs, corpus):
    got = {r.doc_id: r for r in syncmers.fingerprint_pairs(docs).collect()}
    order = sorted(corpus, reverse=True)
    for (d, t), (n, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        r = got[d]
        edited = t[: len(t) - half] + u[:half]
        own, changed, after = (brute_fingerprint(x) for x in (t, edited, u))
        assert r.n_chars == len(t) and r.edited_text == edited
        assert (r.fingerprint, r.edited_fingerprint) == (" ".join(own), " ".join(changed))
        assert (r.near_edited, r.near_next) == (brute_likeness(own, changed), brute_likeness(own, after))
    assert got[1].fingerprint == got[6].fingerprint and got[2].fingerprint == "" == got[4].fingerprint
    real = [r for d, r in got.items() if d >= 1000]
    assert np.mean([r.near_edited for r in real]) > np.mean([r.near_next for r in real]) + 0.2
    assert syncmers.fingerprint_pairs(empty(docs)).count() == 0
    assert syncmers.fingerprint_pairs(docs.filter("doc_id = 1")).first().near_next == 1


def test_fingerprints_of_ties(spark):
    """Rows of one doc_id go by text, descending; a null doc_id is last and followed by the first row."""
    rows = [(5, "bbbb"), (5, "aaaa"), (5, "aaaa"), (4, "cccc"), (None, "zzzz")]
    got = sorted((r.doc_id or 0, r.edited_text, r.near_next) for r in syncmers.fingerprint_pairs(frame(spark, rows)).collect())
    assert got == [(0, "zzbb", 0.0), (4, "cczz", 0.0), (5, "aaaa", 1.0), (5, "aacc", 0.0), (5, "bbaa", 0.0)]


def test_closed_syncmers_are_context_free(spark):
    from pyspark.sql import functions as F

    words = [f"w{i * 7919 % 1013}" for i in range(400)]
    other = [f"v{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join([*other, *words])), (3, " ".join([*words[:200], "edit", *words[200:]]))]
    fp = {r.doc_id: r.fp.split() for r in spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", syncmers.fingerprint(F.col("text"))).collect()}
    got = {d: {x[:12] for x in f} for d, f in fp.items()}
    assert got[1] <= got[2] and len(got[1] - got[3]) <= syncmers.K and 100 < len(got[1]) < 300
    assert all(int(x[12:]) <= syncmers.K - syncmers.S for f in fp.values() for x in f) and len(set(fp[1]) - set(fp[2])) <= 1


def test_long_texts_keep_all_anchors(spark):
    rng = np.random.default_rng(11)
    one, two, passage = ([f"{p}{x}" for x in rng.integers(0, 10**9, n)] for p, n in (("a", 4000), ("b", 4000), ("c", 100)))
    rows = [(2, " ".join([*one[:2000], *passage, *one[2000:]])), (1, " ".join([*passage, *two]))]
    got = {r.doc_id: r for r in syncmers.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    x, y = set(got[2].fingerprint.split()), set(got[1].fingerprint.split())
    assert len(x) > 1500 < len(y) and len(x & y) >= 30 and got[2].near_next == len(x & y) / len(x | y)


def test_licences(spark):
    docs = frame(spark, [(1, "Intro.\nReleased under the MIT License.\n"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, "Licensed under the Apache License, Version 2.0. Unrelated! RELEASED under the MIT license"), (5, "Permission is hereby granted."), (6, "licensed under the apache license")])
    got = {r.doc_id: r.licenses for r in licences.license_scan(docs).collect()}
    assert got == {1: "mit", 2: "cc-by-nc-4.0", 3: "", 4: "apache-2.0,mit", 5: "", 6: ""}
    assert licences.license_scan(empty(docs)).count() == 0


def test_standard_licence_texts(spark):
    import textwrap

    full = {
        "apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "    http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
        "mit": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
        "gpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."),
        "bsd-2-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    }
    full["bsd-3-clause"] = (*full["bsd-2-clause"], "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")
    full["mpl-2.0"] = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",)
    full["lgpl-2.1"] = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",)
    full["isc"] = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",)
    rows, want = [], {}
    for name, paragraphs in full.items():
        for width, lead in ((72, ""), (60, "# "), (5000, "")):
            text = "Some file.\n\n" + "\n\n".join("\n".join(lead + x for x in textwrap.wrap(p, width)) for p in paragraphs) + "\n\nCode follows"
            want[len(rows)] = name
            rows.append((len(rows), text))
    got = {r.doc_id: r for r in licences.license_scan(frame(spark, rows)).collect()}
    assert {d: r.licenses for d, r in got.items()} == want
    assert {got[i].sentence_ids for i in range(3)} == {"a1,a2,a3,a4"} and {got[i].sentence_ids for i in range(6, 9)} == {"g2,g3,g4"}
    long = "\n".join(rows[0][1] if i % 500 == 0 else f"line {i} of filler" for i in range(5000))
    odd = {r.doc_id: (r.n_sentences, r.licenses) for r in licences.license_scan(frame(spark, [(1, ""), (2, long), (3, "All rights reserved."), (3, "x"), (None, "All rights reserved.")])).collect() if r.doc_id != 3}
    assert odd[1] == (0, "") and odd[2][1] == "apache-2.0" and odd[None] == (1, "all-rights-reserved")
    sentences = spark.createDataFrame([("x1", "You may: LOOK."), ("x2", "But not touch"), ("x3", "Ever")], "id string, sentence string")
    rules = spark.createDataFrame([("look", ["x1"]), ("look-only", ["x1", "x2"]), ("never", ["x2", "x3"])], "license string, ids array<string>")
    own = {r.doc_id: (r.sentence_ids, r.licenses) for r in licences.license_scan(frame(spark, [(1, "You may\nlook. But not touch. Ever."), (2, "You may: look."), (3, "You may look, but")]), sentences, rules).collect()}
    assert own == {1: ("x1,x2,x3", "look-only,never"), 2: ("x1", "look"), 3: ("", "")}
    part = "not released\nunder the MIT License or such"
    assert licences.license_scan(frame(spark, [(1, part)])).first().licenses == ""


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_exact(corpus, name):
    path = public_tokenizers.path(name)
    plain, texts = Tokenizer.from_file(path), [t or "" for _, t in corpus] + ["'S'", "''s 're", " \n\n x  y \t\r\n", "a\x0bb\x0cc", "ÀÖ×÷ÿ ſ"]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder.of(path).encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark, docs, corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    ids = {d: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for d, t in corpus}
    rows = pack.pack_documents(docs, path, with_ids=True).toPandas()
    for d, own in rows.groupby("doc_id"):
        own = own.sort_values("start")
        assert own["start"].tolist() == [0, *own["length"].cumsum()[:-1]] and [x for p in own["ids"] for x in p] == ids[d] and (own["doc_tokens"] == len(ids[d])).all()
        assert own["ids_crc32"].tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own["ids"]]
    assert set(rows["doc_id"]) == set(ids)
    source = {r.doc_id: r.source for r in docs.collect()}
    weight = defaultdict(int)
    for d, x in ids.items():
        weight[source[d]] += len(x)
    total, sequences = sum(weight.values()), list(rows.groupby("sequence_id"))
    for s, own in sequences:
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
        full = own["length"].sum()
        assert full == 2048 if s < total // 2048 else full & (full - 1) == 0
        if full == 2048:
            share = own.groupby(own["doc_id"].map(source).fillna("none"))["length"].sum()
            assert all(abs(share.get(q or "none", 0) - 2048 * w / total) <= 2 for q, w in weight.items())
    assert rows["length"].sum() == total
    assert pack.pack_documents(empty(docs), path).count() == 0
    assert pack.pack_documents(docs.unionByName(docs), path).agg({"length": "sum"}).first()[0] == 2 * total


def test_mixture_is_monotone():
    m = pack.Mixture([1, 5000, 3, 70_000, 70_000, 12])
    got = m.served(np.arange(0, m.all + 1, 997))
    assert (np.diff(got, axis=0) >= 0).all() and (got.sum(1) == np.arange(0, m.all + 1, 997)).all()


def test_token_files(spark, docs, corpus, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, at, want = Tokenizer.from_file(path), 0, {}
    ids = {}
    for d, t in sorted(corpus):
        ids[d] = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want[d] = (at, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes()))
        at += len(ids[d])
    assert {r.doc_id: tuple(r)[1:] for r in token_files.token_files(docs, path).collect()} == want
    assert token_files.token_files(empty(docs), path).count() == 0
    manifest = token_files.write_token_files(docs, path, str(tmp_path / "out")).collect()
    with open(manifest[0].file, "rb") as f:
        reader = token_files.Reader(f)
        d = reader.doc_ids[len(reader.doc_ids) // 2]
        assert [(i, x.tolist()) for i, x in reader.select([d])] == [(d, ids[d])]
        data = bytearray(open(manifest[0].file, "rb").read())
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(data)), read_across_frames=True).read()
    assert len(whole) == int(reader.unpacked.sum())  # any reader of the format can read the file
    data[int(reader.at[1]) - 1] ^= 1
    with pytest.raises(Exception):
        broken = token_files.Reader(io.BytesIO(bytes(data)))
        broken.ids(0)


def brute_lines(docs, least=20, most=3):
    held = defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held[key(x)]) < most or d == max(held[key(x)])]
        out[d] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_line_dedup(spark, corpus):
    rows = [*corpus, (20, "  A Line of twenty characters\nx"), (21, "a line of TWENTY characters\t\ny\na line of twenty characters"), (22, "z\na line of twenty characters"), (23, "ÄÖ line of twenty characters"), (24, "äö line of twenty characters")]
    docs = frame(spark, rows).repartition(3)
    assert {r.doc_id: tuple(r)[1:] for r in line_dedup.line_dedup(docs).collect()} == brute_lines(rows)
    assert line_dedup.line_dedup(empty(docs)).count() == 0


def brute_components(docs):
    sets = {}
    for d, t in docs:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
        sets[d] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} - {()}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def test_near_duplicates(spark, corpus):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = list(corpus)
    for i in range(150):  # a crowd of near copies around the threshold
        own = list(base)
        for j in rng.choice(120, rng.integers(0, 9), replace=False):
            own[j] = f"edit{i}-{j}"
        rows.append((5000 + i, " ".join(own)))
    docs = frame(spark, rows).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    assert near_dedup.near_duplicates(empty(docs)).count() == 0
    twice = near_dedup.near_duplicates(docs.unionByName(docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in twice} == got and len(twice) == len(got)


def crowd(count, words, low, high, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for i in range(count):
        own = list(base)
        for j in rng.choice(words, rng.integers(low, high + 1), replace=False):
            own[j] = f"edit{i}-{j}"
        out.append((i + 1, " ".join(own)))
    return out


def roots_of_crowd(rows):
    """Components by all pairs; only shingles of several documents can be shared, so a matrix of those gives the links."""
    sets = [set(zip(t.split(), t.split()[1:])) for _, t in rows]
    held = defaultdict(int)
    for s in sets:
        for g in s:
            held[g] += 1
    place = {g: i for i, g in enumerate(g for g, n in held.items() if n > 1)}
    m = np.zeros((len(rows), len(place)), "f4")
    for r, s in enumerate(sets):
        m[r, [place[g] for g in s if g in place]] = 1
    size = np.array([len(s) for s in sets])
    both = m @ m.T
    linked = 100 * both >= 80 * (size[:, None] + size[None] - both)
    root = np.arange(len(rows))
    while True:
        new = np.where(linked, root[None], len(rows)).min(1)
        new = new[new]
        if (new == root).all():
            return {rows[i][0]: rows[r][0] for i, r in enumerate(root)}, int(linked.sum() - len(rows)) // 2, float((both / (size[:, None] + size[None] - both)).mean())
        root = new


@pytest.mark.parametrize("count, words, low, high, seed", [(1200, 150, 4, 6, 5), (3000, 150, 4, 7, 6), (400, 3000, 60, 150, 7)])
def test_near_duplicates_in_a_crowd(spark, count, words, low, high, seed):
    """Crowds around the threshold, where most places of an order hold documents that aren't similar enough: no document is
    in a wrong component."""
    rows = crowd(count, words, low, high, seed)
    want, links, mean = roots_of_crowd(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows).repartition(4)).collect()}
    assert 0.7 < mean < 0.85 and links > 0 and 1 < len(set(want.values())) < count
    assert sum(got[d] != c for d, c in want.items()) == 0


def test_regions_are_shared_as_often_as_said():
    """Pairs at the threshold share a region of each order about 0.8^DEPTH of the time."""
    rng = np.random.default_rng(1)
    shared = []
    for _ in range(300):
        both, one, two = (rng.integers(0, 2**64, n, "u8") for n in (320, 40, 40))
        x, y = (near_dedup.orders(np.unique(np.r_[both, z]))[0] for z in (one, two))
        shared.append((x == y).mean())
    assert abs(np.mean(shared) - 0.8**near_dedup.DEPTH) < 0.02 and np.std(shared) < 1.3 * (0.328 * 0.672 / near_dedup.TREES) ** 0.5


def test_sketches_never_overstate():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, "u8")) for n in (1, 2, 5, 16, 17, 300, 700)]
    sets += [np.unique(np.r_[s[: int(len(s) * 0.9)], rng.integers(0, 2**64, len(s) // 10, "u8")]) for s in sets]
    sketches = near_dedup._Sketches([near_dedup.sketch(s) for s in sets])
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    fits = near_dedup._able(np.array([len(s) for s in sets])[i], np.array([len(s) for s in sets])[j])
    i, j = i[fits], j[fits]
    assert (sketches.differ(i, j) <= [len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}


def test_token_counts(spark, docs, corpus):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(docs, model).collect()}
    assert got == {d: (len((t or "").encode()), n := len(plain.encode(t or "")), n > 4096) for d, t in corpus}
    tricky = ["\n", " \n ", "a\n\n  b \n", "▁", "▁a ▁▁ b", "\r\n\r\r", "   ", "a" + " " * 40 + "b", "\t \t"]
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, list(enumerate(tricky))), model).collect()} == {i: len(plain.encode(t)) for i, t in enumerate(tricky)}
    twice = token_counts.token_counts(docs.unionByName(docs), model).collect()
    assert sorted(map(tuple, twice)) == sorted([(d, *v) for d, v in got.items()] * 2)
    assert token_counts.token_counts(empty(docs), model).count() == 0


KIND_RE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    out = []
    for k, p in enumerate(KIND_RE):
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans(spark, corpus):
    rng = np.random.default_rng(3)
    texts = [t for _, t in corpus] + ["".join(rng.choice(list("a1@.+- (_9\n"), 60)) for _ in range(3000)] + ["0001.2.3.256 0000001.2.3.4", "1.2.3.4.5.6.7.8"]
    for t in texts:
        assert pii.base_spans(t or "") == brute_spans(t), repr(t)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 7 = 0").collect()]
    assert sum(len(pii.base_spans(t)) for _, t in docs) > 20 and all(pii.base_spans(t) == brute_spans(t) for _, t in docs)


def test_pii(spark, docs, corpus):
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for d, t in corpus:
        want = brute_spans(t)
        r = got[d]
        assert r.base_sha256 == hashlib.sha256(pii.written(want).encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in want) for k in range(4))
        assert set(filter(None, pii.written(want).split(","))) <= set(r.spans.split(","))
    assert pii.find_pii(empty(docs)).count() == 0


def test_beliefs_against_enumeration():
    """On a graph without loops, messages give the marginals that summing over all labellings gives."""
    from itertools import product

    rng = np.random.default_rng(2)
    field = pii.SkipChainField()
    field.node = rng.normal(size=field.node.shape)
    field.edges = [rng.normal(size=w.shape) for w in field.edges]
    feats = rng.integers(0, pii.WEIGHTS, (5, pii.SLOTS))
    evidence = np.array([0, 2, 0, 0, 0])
    kinds = [np.array([[0, 1], [3, 4]]), np.array([[1, 3]]), np.array([[0, 2]])]
    got = field.beliefs(feats, evidence, *kinds)
    want = np.zeros((5, 5))
    for labels in product(range(5), repeat=5):
        if labels[1] == 2:
            s = sum(field.node[feats[i], x].sum() for i, x in enumerate(labels) if i != 1)
            s += sum(w[labels[x], labels[y]] for w, e in zip(field.edges, kinds) for x, y in e)
            for i, x in enumerate(labels):
                want[i, x] += np.exp(s)
    assert np.abs(got - want / want.sum(1, keepdims=True)).max() < 1e-3


def test_added_spans_against_the_field(spark, docs, corpus):
    """The query's spans are those of each document's graph on its own under the same field."""
    field = pii.train(docs)
    got = {r.doc_id: r.spans for r in pii.find_pii(docs, field).collect()}
    for d, t in corpus:
        base = pii.base_spans(t or "")
        more = pii.added_spans([(base, pii.tokens_of(t or "", base))], field)[0]
        assert not any(a < e and s < b for s, e, _ in more for a, b, _ in base)
        assert got[d] == pii.written(sorted([*base, *more], key=lambda x: (x[0], x[2], x[1])))
    twice = pii.find_pii(docs.unionByName(docs), field).collect()
    assert sorted((r.doc_id, r.spans) for r in twice) == sorted([*got.items()] * 2)


def test_long_documents_train(spark):
    text = " ".join(f"call +1 ({i % 900 + 100}) 555-{i:04d} now" for i in range(400))
    assert np.abs(pii.train(frame(spark, [(1, text)])).node).max() > 0


def test_scores_are_sums_of_table_entries(spark, docs, corpus):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(1000, 1200)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert model.pairs and any(np.abs(t).max() > 0 for t in model.tables)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for d, t in corpus:
        x = quality.features(t or "")
        f = model.base
        for j, value in enumerate(x):
            f += model.tables[j][sum(edge <= value for edge in model.edges[j])]
        for a, b, table in model.pairs:
            f += table[sum(e <= x[a] for e in model.wide[a]), sum(e <= x[b] for e in model.wide[b])]
        assert abs(got[d].score - 1 / (1 + np.exp(-f))) < 1e-9 and got[d].predicted == (got[d].score >= 0.3)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
    known = [(i, y) for i, y in ((i, int(i % 3 == 0)) for i in range(1000, 1200)) if zlib.crc32(str(i).encode()) % 5]
    text = dict(corpus)
    x, y = np.array([quality.features(text[i] or "") for i, _ in known]), np.array([y for _, y in known], "f8")
    order = np.lexsort([*x.T, y])
    again = quality.AdditiveModel().fit(x[order], y[order])
    assert all(np.array_equal(p, q) for p, q in zip(model.tables, again.tables))
    twice = quality.score(docs.unionByName(docs), model).collect()
    assert sorted((r.doc_id, r.score) for r in twice) == sorted([(d, r.score) for d, r in got.items()] * 2)


def test_skip_edges_carry_labels(spark):
    numbers = [f"({i:03d}) 555-{i * 37 % 10000:04d}" for i in range(100, 160)]
    rows = [(i, f"call +1 {x} today. " + "filler words and more. " * 20 + f"Again, {x} is it; code 8{i}7 no.") for i, x in enumerate(numbers)]
    rows += [(1000 + i, f"order 55{i} of 20{i:02d}, token = \"04dbe{i}bab91ab85687d33\" end.") for i in range(60)]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, rows)).collect()}
    added = [r for i, r in got.items() if i < 1000 and r.n_added]
    assert len(added) >= 50 and all(s.startswith("phone") for r in added for s in r.spans.split(","))
    assert not any(r.n_added for i, r in got.items() if i >= 1000)


def test_labels_reach_all_repeats(spark):
    numbers = [f"({i:03d}) 555-{i * 37 % 10000:04d}" for i in range(100, 160)]
    rows = [(i, f"call +1 {x} today. " + f"filler words and more. Again, {x} is it. " * (50 if i == 7 else 1)) for i, x in enumerate(numbers)]
    rows += [(1000 + i, f"order 55{i} of 20{i:02d}, token = \"04dbe{i}bab91ab85687d33\" end.") for i in range(60)]
    got = {r.doc_id: r.n_added for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got[7] >= 50 and got[8] == 1 and not any(got[1000 + i] for i in range(60))


def test_lines_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    line = "a line of more than twenty characters"
    rows = [(None, "one"), (None, f"two\n{line}"), (5, f"x\n{line}\ny"), (5, "x\nown line here\ny"), (6, f"{line}\n6")]
    out = corpus_pipeline.lines(spark, frame(spark, rows), SF)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "one"), (0, f"two\n{line}"), (5, "x\nown line here\ny"), (5, "x\ny"), (6, f"{line}\n6")]
    twice = line_dedup.line_dedup(frame(spark, [(5, line), (5, line), (6, line)]))
    assert [r.n_dropped for r in twice.collect()] == [0, 0, 0]


def test_null_ids_and_order(spark):
    rows = [(None, "some text here to read"), (None, None), (3, "some text here to read")]
    docs = frame(spark, rows)
    byte, word, piece = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
    items = spark.createDataFrame([(None, "some text here"), (2, None)], "item_id long, text string")
    assert pack.pack_documents(docs, byte).count() >= 3
    assert [r.doc_id for r in token_files.token_files(docs, word).orderBy("start").collect()] == [None, None, 3]
    assert token_counts.token_counts(docs, piece).count() == 3 and pii.find_pii(docs).count() == 3
    assert syncmers.fingerprint_pairs(docs).count() == 3 and line_dedup.line_dedup(docs).count() == 3
    assert {(r.doc_id, r.n_hit) for r in decontaminate.decontamination_report(docs, items).collect()} == {(None, 3), (3, 3)}
    assert sorted((r.doc_id or 0, r.kept) for r in near_dedup.near_duplicates(docs).collect()) == [(0, True), (0, True), (3, True)]
    assert licences.license_scan(docs).count() == 3


CLASHES = ("gone", "several", "row", "kept", "lines", "md5", "doc", "same", "n_lines", "kept_text", "n_dropped", "score", "label", "w", "n", "queue", "start", "root", "bits", "a.b", "text_", "GONE_")


def test_stages_on_odd_tables(spark):
    """Null and repeated doc_ids, null and empty texts, columns of any name: each stage's defined result."""
    import corpus_pipeline

    line = "a line of more than twenty characters"
    rows = [(None, "same words here and there"), (None, "same words here and there"), (1, "same words here and there"), (1, "same words here and there"), (2, None), (3, ""), (4, f"{line}\nfour"), (4, f"{line}\nother four"), (5, f"{line}\nfive"), (6, line)]
    base = spark.createDataFrame([(d, t, "en", None, len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(CLASHES):
        base = base.withColumn(name, __import__("pyspark.sql.functions").sql.functions.lit(i))
    stages = dict(corpus_pipeline.STAGES)

    def out(name, docs=base):
        got = stages[name](spark, docs, SF)
        if name != "pack":
            assert got.columns == base.columns and all(tuple(r)[5:] == tuple(range(len(CLASHES))) for r in got.collect())
            return sorted(((r.doc_id or 0, r.text or "") for r in got.collect()))
        return sorted({r.doc_id or 0 for r in got.collect()})

    every = sorted((d or 0, t or "") for d, t in rows)
    assert out("lines") == sorted([x for x in every if x[0] < 4] + [(4, "four"), (4, "other four"), (5, "five"), (6, line)])
    same = "same words here and there"
    assert out("near_duplicates") == sorted([(0, same)] * 2 + [(1, same), (2, ""), (3, ""), (4, f"{line}\nother four"), (5, f"{line}\nfive")])  # 6 of 7 shingles: 6 goes
    assert out("pack") == [0, 1, 2, 3, 4, 5, 6]
    items = spark.createDataFrame([(1, same)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminate.drop_contaminated(base, items).collect()) == [x for x in every if x[0] != 1]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id or 0, r.text or "") for r in quality.keep_quality(base, labels).collect()) == every
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, base.limit(0), SF).count() == 0, name


def test_token_files_of_ties(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(1, "b"), (1, "a"), (None, "x y"), (1, "a"), (2, "")]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_files(frame(spark, rows), path).orderBy("start").collect()]
    at, want = 0, []
    for d, t in [(None, "x y"), (1, "a"), (1, "a"), (1, "b"), (2, "")]:
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_target_proportions(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, "some words of a text " * 40, f"s{i % 2}" if i % 10 else None) for i in range(200)], "doc_id long, text string, source string")
    rows = pack.pack_documents(docs, path, targets={"s0": 3.0, "s1": 1.0, None: 0.5}).toPandas()
    of = {r.doc_id: r.source for r in docs.collect()}
    first = rows[rows["sequence_id"] == 0].groupby(rows["doc_id"].map(of).fillna("none"))["length"].sum()
    assert abs(first["s0"] - 2048 * 3 / 4.5) <= 2 and abs(first["s1"] - 2048 / 4.5) <= 2 and abs(first["none"] - 2048 * 0.5 / 4.5) <= 2
    assert rows["length"].sum() == rows.drop_duplicates("doc_id")["doc_tokens"].sum()
    with pytest.raises(ValueError):
        pack.Mixture([5, 5], 4, [1.0, 0.0])


def test_shared_queues_keep_their_sources(spark, monkeypatch):
    monkeypatch.setattr(pack, "SLICE_ROWS", 40)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, " ".join(f"word{i + j}" for j in range(i * 7 % 90)) or None, f"s{i % 9 // 2}" if i % 13 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5, "doc_id")
    ids = {d: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    of, total, length = {d: q for d, _, q in rows}, defaultdict(int), 64
    for d, x in ids.items():
        total[of[d]] += len(x)
    for most in (1, 3):
        monkeypatch.setattr(pack, "MAX_QUEUES", most)
        got = pack.pack_documents(docs, path, length=length, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
        for d, own in got.groupby("doc_id"):
            own = own.sort_values("start")
            assert [x for p in own["ids"] for x in p] == ids[d] and (own["doc_tokens"] == len(ids[d])).all()
            assert own["start"].tolist() == [0, *own["length"].cumsum()[:-1]]
            assert own["ids_crc32"].tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own["ids"]]
        whole = sum(total.values())
        for s, own in got.groupby("sequence_id"):
            assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
            assert own["length"].sum() == length if s < whole // length else own["length"].sum() <= length
        served, all_of = defaultdict(int), 0
        for d, n in zip(got["doc_id"], got["length"], strict=True):
            served[of[d]] += n
            all_of += n
            assert all(abs(served[q] - w * all_of / whole) <= length * 4 for q, w in total.items())
        assert all_of == whole and set(got["doc_id"]) == set(ids)
    with pytest.raises(ValueError):
        pack.pack_documents(docs, path, targets={"s0": 2.0})


def test_rare_source_in_bounded_memory():
    import tracemalloc

    mixture = pack.Mixture([5000, 10**12, 10**12 // 3, *[10**9] * 20])
    tracemalloc.start()
    run, first, size, sequence, offset = mixture.pieces(np.zeros(10, "i8"), np.arange(10) * 500, np.full(10, 500))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size.sum() == 5000 and (offset + size <= 2048).all() and most < 100e6


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows = [tuple(r) for r in out.collect()]
        before = {r.doc_id: r.text for r in at.collect()}
        ids = [r[0] for r in rows]
        assert 0.5 * len(before) < len(ids) == len(set(ids)) and set(ids) <= set(before)
        if name == "lines":
            want = brute_lines(list(before.items()))
            assert {r[0]: r[1] for r in rows} == {d: v[2] for d, v in want.items()} and all(r[4] == len(r[1]) for r in rows)
        if name == "near_duplicates":
            assert set(ids) == {d for d, v in brute_components(list(before.items())).items() if v[2]}
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(ids) == {d for d, v in brute_contamination(list(before.items()), items).items() if not v[4]}
        at = spark.createDataFrame(pd.DataFrame(rows, columns=docs.columns), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(ids)
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == packed.columns and whole.agg({"length": "sum"}).first() == packed.agg({"length": "sum"}).first()
