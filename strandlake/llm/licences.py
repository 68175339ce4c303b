"""License scans by sentence rules, with DataFrame functions only.

Known licence sentences are a table of any size, and so are the rules. Each place of a text where a sentence begins has a key, the hash of
the first words from there. Keys that a Bloom filter of the known sentences' keys doesn't hold are passed over inside the row; the others are
joined to the table, and the words from there compared with the whole known sentence, which may run over several of the text's
sentences, as lines are wrapped and as it has breaks inside; it begins and ends at breaks. What is found is the text's run of identifiers.
All short runs in it are joined to the rules, each an ordered run of identifiers. At both steps a longer match hides the shorter ones that it
overlaps.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, read_table, texts
from .decontaminate import _bloom

BREAK = r"[.!?;:]+(?:[ \t\n\r\f\x0b]+|\z)|[\n\r]+"
#: Words of a key, at most.
KEY_WORDS = 3
#: Known sentences and rules (some 200 bytes each) that may be broadcast.
BROADCAST_ROWS = 100_000

# Known sentences, normalised, by identifier.
SENTENCES = {
    "a1": "licensed under the apache license version 2 0",
    "a2": "you may not use this file except in compliance with the license",
    "a3": "you may obtain a copy of the license at",
    "a4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "m1": "released under the mit license",
    "m2": "licensed under the mit license",
    "m3": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "m4": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "g1": "this work is licensed under the gnu general public license version 3",
    "g2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "g3": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "g4": "see the gnu general public license for more details",
    "c1": "licensed under cc by nc 4 0",
    "c2": "licensed under cc by 4 0",
    "c3": "licensed under cc by sa 4 0",
    "c4": "this work is licensed under a creative commons attribution 4 0 international license",
    "b1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "b2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "b3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "b4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "g5": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "g6": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "g7": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "i1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "p1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "p2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "u1": "this is free and unencumbered software released into the public domain",
    "r1": "all rights reserved",
    "s1": "spdx license identifier apache 2 0",
    "s2": "spdx license identifier mit",
    "s3": "spdx license identifier bsd 3 clause",
    "s4": "spdx license identifier gpl 3 0 or later",
}
# Further wordings of known sentences, from the licences' own texts.
WORDINGS = {
    "licensed under the apache license version 2 0 the license": "a1",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "a3",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "a3",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "m3",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is": "b4",
    "spdx license identifier gpl 3 0 only": "s4",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "i1",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "m4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "c1",
    "this work is licensed under cc by nc 4 0": "c1",
    "this work is licensed under cc by 4 0": "c2",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "c3",
    "this work is licensed under cc by sa 4 0": "c3",
}
# Licences by their published short identifiers, and by their names as sentences give them.
SPDX = {
    "apache-2.0": ("Apache-2.0",), "mit": ("MIT",), "gpl-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"), "gpl-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"),
    "lgpl-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"), "lgpl-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"), "agpl-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "bsd-2-clause": ("BSD-2-Clause",), "bsd-3-clause": ("BSD-3-Clause",), "isc": ("ISC",), "mpl-2.0": ("MPL-2.0",), "unlicense": ("Unlicense",), "bsl-1.0": ("BSL-1.0",), "zlib": ("Zlib",), "epl-2.0": ("EPL-2.0",), "cc0-1.0": ("CC0-1.0",),
    "cc-by-4.0": ("CC-BY-4.0",), "cc-by-sa-4.0": ("CC-BY-SA-4.0",), "cc-by-nc-4.0": ("CC-BY-NC-4.0",), "artistic-2.0": ("Artistic-2.0",), "wtfpl": ("WTFPL",), "eupl-1.2": ("EUPL-1.2",),
}
NAMES = {
    "apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"), "mit": ("mit license", "mit licence"),
    "gpl-2.0": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2", "gpl version 2", "gplv2"),
    "gpl-3.0": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3", "gpl version 3", "gplv3", "gnu general public license version 3 29 june 2007"),
    "lgpl-2.1": ("gnu lesser general public license version 2 1", "gnu lgpl version 2 1", "lgplv2 1"), "lgpl-3.0": ("gnu lesser general public license version 3", "lgplv3"), "agpl-3.0": ("gnu affero general public license version 3", "agplv3"),
    "bsd-2-clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"), "bsd-3-clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"), "isc": ("isc license",),
    "mpl-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0"), "unlicense": ("unlicense",), "bsl-1.0": ("boost software license version 1 0", "boost software license 1 0"), "zlib": ("zlib license",),
    "epl-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0"), "cc0-1.0": ("creative commons zero v1 0 universal", "cc0 1 0"), "cc-by-4.0": ("creative commons attribution 4 0 international license", "cc by 4 0"),
    "cc-by-sa-4.0": ("creative commons attribution sharealike 4 0 international license", "cc by sa 4 0"), "cc-by-nc-4.0": ("creative commons attribution noncommercial 4 0 international license", "cc by nc 4 0"),
    "artistic-2.0": ("artistic license 2 0",), "bsd": ("bsd style license that can be found in the license file",),
}
# What stands before a licence's name where a sentence gives it.
LEADS = (
    "licensed under", "licensed under the", "released under", "released under the", "distributed under", "distributed under the", "available under the", "made available under the", "uses the", "this project uses the", "this software uses the", "is licensed under the",
    "this project is licensed under the", "this software is licensed under the", "this work is licensed under", "this work is licensed under the", "this file is licensed under the", "this code is licensed under the", "this program is licensed under the", "this project is licensed under the terms of the",
    "use of this source code is governed by a", "use of this source code is governed by the", "license", "the",
)
# The titles and openings of licences' own texts.
TITLES = {"apache-2.0": ("apache license version 2 0 january 2004",), "gpl-3.0": ("gnu general public license version 3 29 june 2007",), "gpl-2.0": ("gnu general public license version 2 june 1991",), "bsl-1.0": ("boost software license version 1 0 august 17th 2003",), "mit": ("the mit license mit",), "mpl-2.0": ("mozilla public license version 2 0",)}

# Rules, as ordered sentence identifiers.
RULES = {
    "apache-2.0": (("s1",), ("a1",), ("a1", "a2"), ("a1", "a2", "a3"), ("a1", "a2", "a3", "a4")),
    "mit": (("s2",), ("m1",), ("m2",), ("m3", "m4")),
    "gpl-3.0": (("s4",), ("g1",), ("g2", "g3", "g4"), ("g2",)),
    "cc-by-nc-4.0": (("c1",),),
    "cc-by-4.0": (("c2",), ("c4",)),
    "cc-by-sa-4.0": (("c3",),),
    "bsd-2-clause": (("b1", "b2", "b3"),),
    "bsd-3-clause": (("s3",), ("b1", "b2", "b3", "b4")),
    "gpl-2.0": (("g5", "g3", "g4"), ("g5",)),
    "agpl-3.0": (("g6",),),
    "lgpl-2.1": (("g7",),),
    "isc": (("i1",),),
    "mpl-2.0": (("p1",), ("p1", "p2")),
    "unlicense": (("u1",),),
    "all-rights-reserved": (("r1",),),
}


def known_sentences() -> list[tuple[str, str]]:
    """(id, sentence) of the built-in table: the sentences above, and those that LEADS and SPDX make of names and short identifiers. Such a
    sentence's identifier is its licence's, after a ~."""
    out = [(k, s) for k, s in SENTENCES.items()] + [(k, s) for s, k in WORDINGS.items()]
    given = {s for _, s in out}
    made = [(f"~{name}", f"{lead} {x}".strip()) for name, own in NAMES.items() for x in own for lead in LEADS]
    made += [(f"~{name}", f"{lead} {x}") for name, own in SPDX.items() for x in own for lead in ("spdx license identifier", "license")]
    made += [(f"~{name}", x) for names in (TITLES, {k: tuple(x for x in own if "license" in x or "licence" in x) for k, own in NAMES.items()}) for name, own in names.items() for x in own]
    return out + sorted({(k, s) for k, s in made if s not in given})


def known_rules() -> list[tuple[str, list[str]]]:
    """(license, ids) of the built-in table: the rules above, and one for each licence that ``known_sentences`` makes sentences of."""
    return [(name, list(ids)) for name, own in RULES.items() for ids in own] + [(name, [f"~{name}"]) for name in sorted({*SPDX, *NAMES, *TITLES})]


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A built-in table."""
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _plain(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(ascii_lower(sentence), "[^a-z0-9]+", " "))


def _key(words: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), F.substring_index(words, " ", k))


def _near(df: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _uncovered(matches: DataFrame, *key: str) -> DataFrame:
    """The distinct matches (key, at, to, size, ...) that overlap no match of greater ``size``: each counts at every place that it covers.
    Where matches are dealt by the key already, they stay where they are."""
    own = [c for c in matches.columns]
    each = matches.withColumn("place", F.explode(F.sequence("at", "to"))).withColumn("most", F.max("size").over(Window.partitionBy(*key, "place")))
    return each.groupBy(*own).agg(F.max("most").alias("most")).filter(F.col("most") == F.col("size")).drop("most")


def license_scan(docs: DataFrame, sentences: DataFrame | None = None, rules: DataFrame | None = None, broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """Licences named in each row of ``docs`` (doc_id, text): doc_id, n_sentences, n_known, sentence_ids (in text order,
    comma-joined), licenses (sorted, comma-joined).

    ``sentences`` (id, sentence: in any case and punctuation; several may have one id, and of several ids of one sentence the least
    counts) and ``rules`` (license, ids: an array of sentence ids in order) replace the built-in tables; either may be of any size, and is
    broadcast up to ``broadcast`` rows. A known sentence inside or across a longer one doesn't count, nor does a rule whose run overlaps
    that of a longer rule; of equally long ones each does.

    Null and empty texts have no sentences. A sentence that occurs twice is listed twice. Each row of ``docs`` gives a row, also where
    doc_ids or whole rows repeat, or a doc_id is null; an empty table gives no rows, and empty tables of sentences or rules find nothing.
    Rows are keyed by doc_id and text, and only keys that may begin a known sentence leave a document's row, so neither a source nor a
    frequent line is a hot key."""
    spark = docs.sparkSession
    if sentences is None:
        sentences = _table(spark, [{"id": k, "sentence": s} for k, s in known_sentences()], "id string, sentence string")
    if rules is None:
        rules = _table(spark, [{"license": name, "ids": ids} for name, ids in known_rules()], "license string, ids array<string>")
    plain = sentences.select("id", _plain(F.col("sentence")).alias("sentence")).filter("sentence <> '' AND id IS NOT NULL").groupBy("sentence").agg(F.min("id").alias("id"))
    n_words = F.size(F.split("sentence", " "))
    known = plain.withColumn("k", F.least(n_words, F.lit(KEY_WORDS)))
    known = materialise(known.withColumn("h", reduce(lambda out, k: F.when(F.col("k") == k, _key(F.col("sentence"), k)).otherwise(out), range(1, KEY_WORDS + 1), F.lit(0).cast("long"))))
    facts = known.agg(F.count("*").alias("n"), F.max(n_words).alias("words"), F.max(F.length("sentence")).alias("letters"), F.collect_set("k").alias("ks")).first()
    bits, n_bits = _bloom(known.select("h"), facts["n"])

    parts = F.filter(F.transform(F.split(ascii_lower(F.col("text")), BREAK, -1), lambda s: F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")
    base = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), parts.alias("parts")).withColumn("n", F.size("parts"))

    def points(k: int) -> Column:
        """The places whose key of k words may be a known one: (at, k, h, held), held the words from there with bars at breaks."""

        def key(p: Column) -> Column:
            return _key(F.array_join(F.slice("parts", p, k), " "), k)

        def may_be(p: Column) -> Column:
            at = key(p).bitwiseAND(F.lit(n_bits - 1))
            return F.getbit(F.element_at(bits, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

        def point(p: Column) -> Column:
            held = F.left(F.concat(F.array_join(F.slice("parts", p, facts["words"]), "|"), F.lit("|")), F.lit(facts["letters"] + 1))
            return F.struct(p.alias("at"), F.lit(k).alias("k"), key(p).alias("key"), held.alias("held"))

        places = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(places, may_be), point)

    own = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.xxhash64("doc_id", "h").alias("key"), F.lit("").alias("held")))  # a row of each document's own
    each = base.select("doc_id", "h", "n", F.explode(F.concat(own, *[points(k) for k in sorted(facts["ks"] or [])])).alias("p")).select("doc_id", "h", "n", "p.*")
    table = _near(known.select("k", F.col("h").alias("key"), "sentence", "id", F.length("sentence").alias("size")), broadcast)
    joined = each.join(table, ["k", "key"], "left")
    begun = F.left("held", F.col("size"))
    is_it = (F.translate(begun, "|", " ") == F.col("sentence")) & (F.substring(F.col("held"), F.col("size") + 1, F.lit(1)) == "|")
    to = F.col("at") + F.length(begun) - F.length(F.replace(begun, F.lit("|"), F.lit("")))
    found = materialise(joined.filter((F.col("k") == 0) | is_it).select("doc_id", "h", "n", "at", to.alias("to"), "size", "id"))

    # dealt by document once: what follows asks for no more than that. Rows that repeat a document find the same
    matches = found.filter("at > 0").select("doc_id", "h", "at", "to", "size", "id").repartition("doc_id", "h")
    runs = materialise(_uncovered(matches, "doc_id", "h").groupBy("doc_id", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "to", "id"))), lambda x: x["id"]).alias("ids")))
    ordered = rules.select("license", "ids").filter("license IS NOT NULL AND size(ids) > 0").withColumn("size", F.size("ids"))
    sizes = sorted(ordered.agg(F.collect_set("size").alias("sizes")).first()["sizes"])  # a few: the lengths of rules
    none = F.array().cast("array<struct<at:int,to:int,size:int,run:array<string>>>")

    def spans(n: int) -> Column:
        """The runs of n ids."""
        each = F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda i: F.struct(i.alias("at"), (i + n - 1).alias("to"), F.lit(n).alias("size"), F.slice("ids", i, n).alias("run")))
        return F.when(F.size("ids") >= n, each).otherwise(none)

    taken = runs.repartition("doc_id", "h").select("doc_id", "h", F.explode(F.concat(none, *map(spans, sizes))).alias("r")).select("doc_id", "h", "r.*")
    named = taken.join(_near(ordered.select(F.col("ids").alias("run"), "license"), broadcast), "run").select("doc_id", "h", "at", "to", "size", "license")

    def part(df: DataFrame, **columns: str) -> DataFrame:
        kinds = {"n": "long", "rows": "long", "ids": "array<string>", "license": "string"}
        return df.select("doc_id", "h", *[F.expr(columns.get(c, "NULL")).cast(kind).alias(c) for c, kind in kinds.items()])

    every = part(found.filter("at = 0"), n="n", rows="1").unionByName(part(runs, ids="ids")).unionByName(part(_uncovered(named, "doc_id", "h"), license="license"))
    out = every.groupBy("doc_id", "h").agg(F.max("n").alias("n_sentences"), F.sum("rows").alias("rows"), F.coalesce(F.max("ids"), F.array().cast("array<string>")).alias("ids"), F.array_sort(F.collect_set("license")).alias("names"))
    each_row = F.sequence(F.lit(1).cast("long"), F.col("rows"))
    return out.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join("names", ",").alias("licenses"), F.explode(each_row).alias("row")).drop("row")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"[{', '.join(repr(y) for y in x)}]" if isinstance(x, list) else repr(x) for x in row) + ")" for row in rows)


#: The same tables, looked up place by place.
ORACLE = rf"""
WITH raw AS (
  SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAK}') AS parts FROM documents
), d AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS ss FROM raw
), k AS (SELECT sentence, min(id) AS id, length(sentence) AS size, split_part(sentence, ' ', 1) AS w FROM (VALUES {_values(known_sentences())}) t(id, sentence) GROUP BY sentence
), f AS (SELECT doc_id, i AS p, array_to_string(ss[i:i + {max(len(s.split()) for _, s in known_sentences())}], '|') || '|' AS held FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM d)
), m AS (
  SELECT doc_id, p, p + length(left(held, size)) - length(replace(left(held, size), '|', '')) AS upto, size, id FROM f JOIN k ON w = regexp_extract(held, '^[a-z0-9]+') WHERE replace(left(held, size), '|', ' ') = sentence AND held[size + 1] = '|'
), u AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.size > m.size AND o.p <= m.upto AND o.upto >= m.p)
), r AS (SELECT doc_id, list(id ORDER BY p, upto, id) AS ids FROM u GROUP BY doc_id
), ru AS (SELECT * FROM (VALUES {_values(known_rules())}) t(license, ids)
), h AS (SELECT doc_id, i AS p, i + len(ru.ids) - 1 AS upto, len(ru.ids) AS size, license FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM r) x JOIN ru ON x.ids[i:i + len(ru.ids) - 1] = ru.ids
), v AS (SELECT DISTINCT doc_id, license FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND o.size > h.size AND o.p <= h.upto AND o.upto >= h.p)
), n AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM v GROUP BY doc_id)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(licenses, '') AS licenses FROM d LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""
