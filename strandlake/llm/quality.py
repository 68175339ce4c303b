"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees on one binned feature at a time learns a table of additive scores for each feature;
the strongest pairs of features then get tables of their own from trees over two. A text's score is the sum of its bins'
entries, added for whole batches at a time, through a logistic function.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, texts

#: Labelled rows to learn from, at most: those of least hash of doc_id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = ("words", "word_length", "distinct_words", "top_word", "repeats", "upper", "digits", "symbols", "other_bytes", "spaces", "short_words", "lines", "line_length", "distinct_lines", "marked_words", "sentence_ends", "entropy")
_MARKED = re.compile(rb"[A-Za-z0-9\x80-\xff][^A-Za-z0-9\x80-\xff\s.,;:?'\")\]]+(?=\s|$)|(?:^|\s)[^A-Za-z0-9\x80-\xff\s]+(?=\s|$)")
_CLASS = np.zeros(256, "u1")
for _c in range(256):
    _b = bytes([_c])
    _CLASS[_c] = 0 if _b.islower() else 1 if _b.isupper() else 2 if _b.isdigit() else 3 if _b.isspace() else 4 if _c < 128 else 5


def features(text: str) -> list[float]:
    """The values of FEATURES for a whole text; zeros for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    seen, n, size = Counter(words), len(words), len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=6) / size
    p = counts[counts > 0] / size
    return [
        np.log1p(n), (size - n) / n, len(seen) / n, max(seen.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, kinds[1], kinds[2], kinds[4], kinds[5], kinds[3],
        sum(len(w) <= 3 for w in words) / n, np.log1p(len(lines)), size / len(lines), len(set(lines)) / len(lines), len(_MARKED.findall(raw)) / n, sum(w.endswith((b".", b"!", b"?")) for w in words) / n, -float((p * np.log2(p)).sum()),
    ]


class AdditiveModel:
    """Look-up tables for single features and pairs of them."""

    def __init__(self, bins: int = 24, coarse: int = 8, rounds: int = 150, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, least: int = 8) -> None:
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs, self.rate, self.least = bins, coarse, rounds, pair_rounds, pairs, rate, least
        self.base, self.edges, self.wide, self.tables, self.pairs = 0.0, [], [], [], []

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)

    def _step(self, g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
        """A shallow tree over ordered bins: each bin's Newton step."""
        out = np.zeros(len(g))

        def grow(a: int, b: int, left: int) -> None:
            G, H, N = g[a:b].cumsum(), h[a:b].cumsum(), n[a:b].cumsum()
            if left and b - a > 1:
                gain = G[:-1] ** 2 / (H[:-1] + 1) + (G[-1] - G[:-1]) ** 2 / (H[-1] - H[:-1] + 1) - G[-1] ** 2 / (H[-1] + 1)
                gain[(N[:-1] < self.least) | (N[-1] - N[:-1] < self.least)] = -1
                cut = int(gain.argmax())
                if gain[cut] > 1e-9:
                    grow(a, a + cut + 1, left - 1)
                    grow(a + cut + 1, b, left - 1)
                    return
            out[a:b] = G[-1] / (H[-1] + 1)

        grow(0, len(g), depth)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        mean = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(mean / (1 - mean)))
        k = x.shape[1]
        self.edges = [self._edges(x[:, j], self.bins) for j in range(k)]
        self.wide = [self._edges(x[:, j], self.coarse) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not len(y) or y.min() == y.max():
            return self
        at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j in range(k):
                p = 1 / (1 + np.exp(-f))
                size = len(self.tables[j])
                step = self.rate * self._step(np.bincount(at[j], y - p, size), np.bincount(at[j], p * (1 - p), size), np.bincount(at[j], minlength=size))
                self.tables[j] += step
                f += step[at[j]]
        two = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.wide)]
        cell = {(a, b): two[a] * (len(self.wide[b]) + 1) + two[b] for a, b in combinations(range(k), 2)}
        p = 1 / (1 + np.exp(-f))
        strength = {ab: float((np.bincount(c, y - p) ** 2 / (np.bincount(c, p * (1 - p)) + 5)).sum()) for ab, c in cell.items()}
        chosen = sorted(strength, key=lambda ab: (-strength[ab], ab))[: self.n_pairs]
        self.pairs = [(a, b, np.zeros((len(self.wide[a]) + 1, len(self.wide[b]) + 1))) for a, b in chosen]
        for _ in range(self.pair_rounds):
            for a, b, table in self.pairs:
                p = 1 / (1 + np.exp(-f))
                g, h, n = (np.bincount(cell[a, b], v, table.size).reshape(table.shape) for v in (y - p, p * (1 - p), np.ones(len(y))))
                step = self.rate * self._pair_step(g, h, n)
                table += step
                f += step[two[a], two[b]]
        return self

    def _pair_step(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A tree that cuts the first feature once and then each side by the second."""
        best, out = -np.inf, np.zeros_like(g)
        for cut in range(1, g.shape[0]):
            step = np.zeros_like(g)
            for rows in (slice(0, cut), slice(cut, None)):
                step[rows] = self._step(g[rows].sum(0), h[rows].sum(0), n[rows].sum(0), 1)
            gain = float((step * g - step**2 * h / 2).sum())
            if gain > best:
                best, out = gain, step
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            f += t[np.searchsorted(e, x[:, j], "right")]
        for a, b, t in self.pairs:
            f += t[np.searchsorted(self.wide[a], x[:, a], "right"), np.searchsorted(self.wide[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-f))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"label": batch["label"], "h": batch["h"], "x": [features(t) for t in batch["text"]]})


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Learn labels.quality from whole texts. Rows of fold 0 are never used; of the rest, at most ``max_rows``, those of
    least hash of doc_id, which bounds what the driver holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    held = texts(docs).join(F.broadcast(chosen), "doc_id").select("label", F.xxhash64("doc_id", "text").alias("h"), "text")
    # rows that repeat a labelled doc_id are each learned from, unless that makes too many: those of least hash stay
    rows = held.mapInPandas(_featured, "label int, h long, x array<double>").orderBy("h", "label").limit(max_rows).toPandas()
    # the order in which rows arrive must not matter
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES))
    order = np.lexsort([*x.T, rows["label"].to_numpy()])
    return AdditiveModel().fit(x[order], rows["label"].to_numpy("f8")[order])


def scorer(model: AdditiveModel):
    """The model's score of a text column; a null text is empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch]).reshape(len(batch), len(FEATURES))
            yield pd.Series(model.score(x))

    return run


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (fold 0), score, predicted of each row of ``docs`` (doc_id, text)."""
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    scored = texts(docs).select("doc_id", held_out, scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` (doc_id, quality) and score every row of ``docs``.

    Null and empty texts have all features zero and a score like any other. Rows that repeat a doc_id are scored each on
    its own and, if labelled, each learned from. A null doc_id isn't held out. Without labels, or with one class
    only, every score is the share of label 1, smoothed. An empty table gives no rows.
    """
    return score(docs, train(docs, labels))


def keep_quality(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, with their own columns, that the classifier predicts 1.

    It learns from the labelled rows of ``corpus``, or of ``docs``. Null and empty texts are scored like any other; rows
    that repeat a doc_id each on their own; null doc_ids are never learned from. An empty table stays empty; other
    columns, whatever their names, are not looked at.
    """
    return docs.filter(scorer(train(docs if corpus is None else corpus, labels))("text") >= THRESHOLD)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
