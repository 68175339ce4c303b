"""The forest's common prefixes and pieces against a reading by letters, and long texts in blocks of bounded bytes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import near_dedup


def values(place):
    return [int(np.uint64(place & (2**64 - 1))) >> (16 * k) & 0xFFFF for k in reversed(range(near_dedup.FURTHER))]


def test_common_values():
    r = random.Random(2)
    x = np.array([r.getrandbits(64) - 2**63 for _ in range(300)], "i8")
    y = np.array([int(a) ^ (r.getrandbits(r.choice([0, 1, 16, 17, 33, 48, 63]))) for a in x], "i8")
    want = [next((k for k, (a, b) in enumerate(zip(values(int(a)), values(int(b)), strict=True)) if a != b), near_dedup.FURTHER) for a, b in zip(x, y, strict=True)]
    assert near_dedup.common_values(x, y).tolist() == want and set(want) == set(range(near_dedup.FURTHER + 1))


@pytest.mark.parametrize("seed", range(5))
def test_pieces_are_cut_where_their_members_differ(seed):
    r, run = random.Random(seed), 8
    rows = sorted((r.choice([1, 1, 1, 2, 3, r.randint(4, 60)]), *(r.randint(0, 3) ** 2 for _ in range(near_dedup.FURTHER))) for _ in range(400))
    joined = np.array([i > 0 and rows[i][0] == rows[i - 1][0] for i in range(len(rows))])
    common = np.array([0] + [next((k for k in range(near_dedup.FURTHER) if a[1 + k] != b[1 + k]), near_dedup.FURTHER) for a, b in zip(rows, rows[1:])])

    def cut(begin, end, depth):
        """The pieces of rows begin to end, which agree in their region and the first ``depth`` - 1 further values."""
        if end - begin <= run:
            return [begin] * (end - begin)
        if depth > near_dedup.FURTHER:
            return [begin + k // run * run for k in range(end - begin)]
        out, at = [], begin
        for i in range(begin + 1, end + 1):
            if i == end or rows[i][: depth + 1] != rows[at][: depth + 1]:
                out += cut(at, i, depth + 1)
                at = i
        return out

    want, at = [], 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[at][0]:
            want += cut(at, i, 1)
            at = i
    assert near_dedup.pieces(joined, common, run).tolist() == want
    assert near_dedup.pieces(joined[:0], common[:0]).tolist() == []


def test_large_sets_meet_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 3000)
    r = random.Random(1)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(1000)]

    def changed(k):
        words = list(base)
        for _ in range(k):
            words[r.randrange(len(words))] = f"n{r.randint(0, 10**9)}"
        return " ".join(words)

    texts = [changed(k) for k in [0, 20, 40, 60, 70, 80, 90, 95, 100, 110, 120, 130] * 3]
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == dict(enumerate(root))
    rows = spark.createDataFrame([(1, i, 1000, i) for i in range(12)], "region long, doc long, n long, root long")
    bodies = rows.select("doc", F.lit("x").cast("binary").alias("bits"))
    seen = near_dedup.across(rows, bodies, lambda batches: (b[["x", "y", "doc"]] for b in batches), "x long, y long, doc long").collect()
    per_cell = {c: len([s for s in seen if (s.x, s.y) == c]) for c in {(s.x, s.y) for s in seen}}
    met = {frozenset((a.doc, b.doc)) for a in seen for b in seen if (a.x, a.y) == (b.x, b.y) and a.doc != b.doc}
    assert len(per_cell) > 4 and len(met) == 66  # several blocks, and every pair meets
