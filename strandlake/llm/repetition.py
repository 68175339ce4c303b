"""Quality rules on the repetition inside a text, from its suffix array.

Texts are read as words. A batch of them is one array of word numbers, with an own alphabet for each text and an end mark that
occurs once, so that suffixes of different texts share nothing. Prefix doubling sorts the suffixes, sorting again only those
that are still tied; the ranks of each doubling are kept and give the longest common prefixes of neighbours by halving steps.
A repeated substring is an interval of suffixes with a common prefix. The deepest interval that a suffix lies in is as long as the
larger of its two neighbours' prefixes, so it holds the spans that all other intervals give that suffix: the union of the deepest
spans is the union of all maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, own_columns, read_table, texts

#: Words of a repeat that counts as one, at least; the share of words in such repeats and the words of the longest one, at most.
LEAST, MOST_COVERED, MOST_LONG = 10, 0.3, 200
#: Words of a text, at least, and the share of words (in hundredths) in repeated windows of WINDOW words, at most.
FEWEST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Words that are sorted together, about; bounds a worker's memory, but for a longer single text.
CHUNK = 500_000
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest long"


def longest_repeats(numbers: np.ndarray) -> np.ndarray:
    """For each place of a sequence the length of the longest substring from there that also occurs elsewhere. ``numbers``
    are from 0 and dense; after each text stands a number of its own, and no two texts share a number."""
    size = len(numbers)
    counts = np.bincount(numbers) if size else np.zeros(0, "i8")
    rank = (np.cumsum(counts) - counts)[numbers].astype("i4")  # the place of the first suffix that begins alike
    levels = [rank]
    tied = np.flatnonzero(counts[numbers] > 1)
    step = 1
    while len(tied):
        # a tied suffix has at least ``step`` words before its end mark, so the place looked at is inside its text
        key = rank[tied].astype("i8") * size + rank[tied + step]
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        old = rank[tied]
        at = np.arange(len(tied))
        new_one = np.concatenate([[True], key[1:] != key[:-1]])
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        first = np.maximum.accumulate(np.where(new_one, at, 0))
        rank = rank.copy()
        rank[tied] = old + (first - np.maximum.accumulate(np.where(new_old, at, 0))).astype("i4")
        levels.append(rank)
        alone = new_one & np.concatenate([new_one[1:], [True]])
        tied = tied[~alone]
        step *= 2
    suffixes = np.empty(size, "i8")
    suffixes[rank] = np.arange(size)
    common = np.zeros(size + 1, "i8")  # of the suffix at each place of the order with the one before
    pair = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1
    a, b = suffixes[pair - 1].copy(), suffixes[pair].copy()
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][a] == levels[level][b]
        a[same] += 1 << level
        b[same] += 1 << level
    common[pair] = b - suffixes[pair]
    out = np.empty(size, "i8")
    out[suffixes] = np.maximum(common[:-1], common[1:])
    return out


def _covered(lengths: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Whether each place lies in a span [i, i + lengths[i]) of at least ``least``; or of ``width`` only."""
    at = np.flatnonzero(lengths >= least)
    steps = np.bincount(at, minlength=len(lengths) + 1) - np.bincount(at + (width or lengths[at]), minlength=len(lengths) + 1)
    return np.cumsum(steps)[: len(lengths)] > 0


def _measured(batch: list[str], least: int) -> list[tuple]:
    """The values of _FIELDS for each text."""
    numbers, bounds, used, facts = [], [0], 0, []
    for text in batch:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # at the ASCII blanks
        own: dict[bytes, int] = {}
        numbers.append(np.fromiter((own.setdefault(w, len(own)) for w in words), "i8", len(words)) + used)
        numbers.append(np.array([used + len(own)]))
        used += len(own) + 1
        bounds.append(bounds[-1] + len(words) + 1)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        facts.append((len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))))
    lengths = longest_repeats(np.concatenate(numbers)) if numbers else np.zeros(0, "i8")
    begin, end = np.array(bounds[:-1], "i8"), np.array(bounds[1:], "i8")

    def per_text(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[end] - upto[begin]

    windows, spans = per_text(_covered(lengths, WINDOW, WINDOW)), per_text(_covered(lengths, least))
    longest = np.maximum.reduceat(lengths, begin) if len(begin) else begin
    return [(*f, int(w), int(s), int(x)) for f, w, s, x in zip(facts, windows, spans, longest, strict=True)]


def _batched(rows: Iterator[pd.Series], least: int) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    for batch in rows:
        out: list[tuple] = []
        held: list[str] = []
        size = 0
        for text in batch:
            text = text or ""
            if held and size + len(text) > 6 * CHUNK:
                out += _measured(held, least)
                held, size = [], 0
            held.append(text)
            size += len(text)
        out += _measured(held, least)
        yield pd.DataFrame(out, columns=names)


def measures(least: int = LEAST):
    """A function of a text column: a struct of _FIELDS. ``n_covered`` counts the words in repeats of at least ``least`` words,
    ``longest`` the words of the longest repeat. A null text reads as empty."""

    @F.pandas_udf(f"struct<{_FIELDS}>")
    def run(rows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _batched(rows, least)

    return run


def repetition_rules(docs: DataFrame, least: int = LEAST, most_covered: float = MOST_COVERED, most_long: int = MOST_LONG) -> DataFrame:
    """doc_id, the values of _FIELDS, base_failed and kept for each row of ``docs`` (doc_id, text).

    ``base_failed``: fewer than FEWEST_WORDS words, or more than MOST_REPEATED hundredths of them in windows of WINDOW words that
    the text holds twice or more. ``kept``: not that, at most ``most_covered`` of the words in repeats of ``least`` words or more,
    and no repeat of more than ``most_long`` words. A null or empty text has no words and fails. Rows that repeat a doc_id, or have
    none, are each judged on their own; other columns, whatever their names, aren't looked at; an empty table gives no rows."""
    m = texts(docs).select("doc_id", measures(least)("text").alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdict = (F.col("n_covered") <= most_covered * F.col("n_words")) & (F.col("longest") <= most_long)
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict)


def keep_unrepetitive(docs: DataFrame, least: int = LEAST, most_covered: float = MOST_COVERED, most_long: int = MOST_LONG) -> DataFrame:
    """The rows of ``docs``, with their own columns, that ``repetition_rules`` keeps."""
    m = fresh(docs, "measured")
    v = F.col(m)
    failed = (v["n_words"] < FEWEST_WORDS) | (100 * v["n_repeat_words"] > MOST_REPEATED * v["n_words"])
    verdict = (v["n_covered"] <= most_covered * v["n_words"]) & (v["longest"] <= most_long)
    return docs.withColumn(m, measures(least)("text")).filter(~failed & verdict).select(*own_columns(docs))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered")


def _windows(width: int) -> str:
    """SQL: the places (doc_id, i) at which a window of ``width`` words begins that its text holds twice or more."""
    return f"SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM (SELECT doc_id, unnest(range(1, len(words) - {width - 2})) AS i, unnest(list_transform(range(1, len(words) - {width - 2}), lambda i: md5(array_to_string(words[i:i + {width - 1}], ' ')))) AS w FROM d)) WHERE c > 1"


def _words_of(name: str, width: int) -> str:
    return f"SELECT doc_id, count(DISTINCT i + j) AS n FROM {name}, unnest(range({width})) u(j) GROUP BY doc_id"


#: The words in repeats of LEAST words or more are those in windows of LEAST words that occur twice, and a repeat of more than
#: MOST_LONG words is such a window of MOST_LONG + 1.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
w3 AS ({_windows(WINDOW)}), c3 AS ({_words_of("w3", WINDOW)}), w10 AS ({_windows(LEAST)}), c10 AS ({_words_of("w10", LEAST)}), far AS (SELECT DISTINCT doc_id FROM ({_windows(MOST_LONG + 1)})),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words, coalesce(c10.n, 0) AS n_covered, far.doc_id IS NOT NULL AS too_long
 FROM d JOIN l USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c10 USING (doc_id) LEFT JOIN far USING (doc_id)),
b AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_covered <= {MOST_COVERED} * n_words AND NOT too_long AS kept, n_covered FROM b"""
