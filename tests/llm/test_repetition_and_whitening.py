"""Repetition rules against a search of all pairs of places, whitening against arithmetic on whole integers."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import repetition, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text, least=repetition.LEAST):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    longest, covered, repeated = 0, set(), set()
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        longest = max(longest, best)
        if best >= least:
            covered.update(range(i, i + best))
        if best >= 3:
            repeated.update(range(i, i + 3))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = n < 50 or 100 * len(repeated) > 50 * n
    kept = not failed and len(covered) <= 0.3 * n and longest <= 200
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(covered), longest, failed, kept


def repeating(seed):
    r = random.Random(seed)
    words = [r.choice("abcdefgh") * r.randint(1, 2 + seed % 3) for _ in range(r.randint(0, 120))]
    for _ in range(r.randint(0, 3)):
        at, size = (r.randrange(len(words) + 1) for _ in range(2))
        words += words[at : at + size % 40]
    return "".join(w + r.choice([" ", "\n", "\t ", " \x0b"]) for w in words)


TEXTS = [
    None, "", " \n\t", "one", "a a", "a a a a a a", "é ü\x1cx\x85y z w\x00", "# a\n# a\n\n\n # a\n<b>&|*$%", "same " * 400, "x y " * 300 + "end", " ".join(map(str, range(60))),
    " ".join(map(str, [*range(300), *range(201)] + list(range(1000, 1700)))), " ".join(map(str, [*range(300), *range(200)] + list(range(1000, 1700)))), " ".join(map(str, [*range(70), *range(30)])), " ".join(map(str, [*range(69), *range(31)])),
    *map(repeating, range(60)),
]


def test_rules(spark):
    docs = spark.createDataFrame([(i if i != 3 else None, t, 5, "x", True) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, measured string, kept boolean").repartition(3)
    # a repeated row, and another text of one doc_id
    docs = docs.unionByName(docs.filter("doc_id IN (9, 20)")).unionByName(docs.filter("doc_id = 10").withColumn("text", F.lit("other")))
    want = Counter((i if i != 3 else None, *brute_rules(t)) for i, t in enumerate(TEXTS))
    want.update([(9, *brute_rules(TEXTS[9])), (20, *brute_rules(TEXTS[20])), (10, *brute_rules("other"))])
    out = repetition.repetition_rules(docs)
    got = Counter(tuple(r) for r in out.collect())
    assert out.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest", "base_failed", "kept"]
    assert got == want and {w[-2:] for w in want} == {(True, False), (False, True), (False, False)}
    kept = repetition.keep_unrepetitive(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(w[0] for w in want.elements() if w[-1])
    assert not repetition.repetition_rules(docs.filter("false")).collect() and not repetition.keep_unrepetitive(docs.filter("false")).collect()


def test_chunks_change_nothing(monkeypatch):
    whole = [tuple(x) for x in next(repetition._batched(iter([TEXTS]), 10)).itertuples(index=False)]
    monkeypatch.setattr(repetition, "CHUNK", 20)
    assert [tuple(x) for x in next(repetition._batched(iter([TEXTS]), 10)).itertuples(index=False)] == whole


def test_repeats_of_a_long_text():
    period = np.arange(700)
    numbers = np.concatenate([np.tile(period, 1000), [700]])
    want = np.concatenate([699_300 - np.arange(700), 700_000 - np.arange(700, 700_000), [0]])  # with the next period, or else the last
    assert (repetition.longest_repeats(numbers) == want).all()


def brute_whitening(rows):
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, v in good)
    size = max(sizes, key=lambda k: (sizes[k], k))
    good = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in good if len(v) == size]
    n, sums = len(good), [sum(x) for x in zip(*(v for _, v in good), strict=True)]
    centred = [[Fraction(n * a - s, n) for a, s in zip(v, sums, strict=True)] for _, v in good]
    covariance = np.array([[float(sum(c[a] * c[b] for c in centred) / n) for b in range(size)] for a in range(size)])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    w = np.array([[float(x) for x in c] for c in centred]) @ axes / np.sqrt(values)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for _, v in good]
    return [i for i, _ in good], n, deviation, w, values / np.trace(covariance)


SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("size", [3, 12])
def test_whitening(spark, size):
    r = np.random.default_rng(size)
    scales = np.linspace(5, 0.5, size)
    vectors = (r.normal(size=(90, size)) * scales + np.where(np.arange(size) == 1, 300, -0.1)).astype("f4")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(200, None), (201, [None] + [1.0] * (size - 1)), (202, [float("nan")] * size), (203, [math.inf] + [0.0] * (size - 1)), (204, []), (205, [1.0] * (size + 1)), (None, rows[3][1]), (5, rows[6][1]), (5, rows[6][1])]
    ids, n, deviation, w, explained = brute_whitening(rows + odd)
    out = whitening.whiten(table(spark, rows + odd))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    k = min(8, size)
    assert len(got) == k * len(ids) and {g["n"] for g in got} == {n} == {93} and len({g["identity_error"] for g in got}) == 1 and got[0]["identity_error"] < 1e-10
    assert Counter((g["vec_id"], g["deviation"]) for g in got) == Counter({x: k * c for x, c in Counter(zip(ids, deviation, strict=True)).items()})
    for c in range(1, k + 1):
        mine = sorted((g["vec_id"] is None, g["vec_id"] or 0, g["whitened"]) for g in got if g["component"] == c)
        mine = np.array([x for *_, x in mine])
        theirs = np.array([x for *_, x in sorted((i is None, i or 0, x) for i, x in zip(ids, w[:, c - 1], strict=True))])
        flipped = np.array([x for *_, x in sorted((i is None, i or 0, -x) for i, x in zip(ids, w[:, c - 1], strict=True))])
        assert min(np.abs(mine - theirs).max(), np.abs(mine - flipped).max()) < 1e-9
        assert np.allclose([g["explained"] for g in got if g["component"] == c], explained[c - 1], rtol=1e-9)


def test_whitening_edges(spark):
    assert not whitening.whiten(table(spark, [])).collect()
    assert not whitening.whiten(table(spark, [(1, None), (2, []), (3, [float("nan")])]), 8).collect()
    got = whitening.whiten(table(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()  # no variance at all
    assert len(got) == 4 and {(g["whitened"], g["explained"], g["identity_error"], g["deviation"], g["n"]) for g in got} == {(None, 0.0, 0.0, 0, 2)}
    got = whitening.whiten(table(spark, [(i, [float(i), float(i)]) for i in range(5)])).collect()  # one component has some
    assert {g["component"]: g["whitened"] is None for g in got} == {1: False, 2: True} and got[0]["identity_error"] < 1e-12
    far = [(i, [float(2**36 + i * 2**30), -1.0, 3.0 * i]) for i in range(40)]  # beyond 64-bit arithmetic
    got = {g["vec_id"]: g["deviation"] for g in whitening.whiten(table(spark, far)).collect()}
    want = dict(zip(*[brute_whitening(far)[i] for i in (0, 2)], strict=True))
    assert got == {i: d if d < 1 << 63 else None for i, d in want.items()} and None in got.values()


def test_sums_do_not_depend_on_partitions(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert whitening.column_sums(vectors.repartition(7)) == whitening.column_sums(vectors.coalesce(1))
    a, b = (whitening.fit(v) for v in (vectors.repartition(7), vectors.coalesce(1)))
    assert np.allclose(a.axes, b.axes, atol=1e-9) and np.allclose(a.values, b.values, rtol=1e-12)
