"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every window of L words that a benchmark item and a document share holds the same least hash of its k-word grams, so
the documents' winnowed grams joined to the items' find each shared window. A hit is then extended to the whole
windows around it, which are compared word by word.

Documents are read once, whatever the benchmark's size. A Bloom filter of the benchmark's fingerprints, of bounded size,
spares most grams of a document the look at their windows. Fingerprints and windows are broadcast up to a checked number
of rows, so that a passage that a third of all documents hold costs no hot key; beyond it they are joined by shuffle,
where adaptive execution splits such keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, read_table, without

#: What stands between words, once A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 5
#: Bits of the Bloom filter, at most (4 MB): 32 a fingerprint while they last.
BLOOM_BITS = 1 << 25
#: Fingerprints (16 bytes each) and windows (some 100 bytes each) that may be broadcast.
BROADCAST_MARKS = 500_000
BROADCAST_WINDOWS = 100_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _gram_at(words: Column, i: Column, k: int) -> Column:
    """Hash of the k words from position i (from 1), above four bits that hold the position modulo 16."""
    return F.xxhash64(F.slice(words, i, k)).bitwiseAND(F.lit(-16)).bitwiseOR(i.bitwiseAND(F.lit(15)).cast("long"))


def _points(words: Column, size: Column, length: int, bits: Column | None = None, n_bits: int = 0) -> Column:
    """The winnowed grams: those that are the least of some window of ``length`` words, as structs of length, gram hash
    and, with ``bits``, the words that windows around the gram can hold and the position of the first.

    ``bits`` is a one-hash Bloom filter of the hashes that matter. Only for grams in it is it looked up whether they are
    the least of a window; the result is as if all grams were winnowed and then filtered.
    """
    k = min(GRAM, length)
    reach = length - k + 1

    def points(gs: Column) -> Column:
        def first(p: Column) -> Column:
            return F.greatest(F.lit(1), p - (reach - 1))

        def last(p: Column) -> Column:
            return F.least(p, size - length + 1)

        def wanted(p: Column) -> Column:
            g = F.element_at(gs, p)
            least = F.exists(F.sequence(first(p), last(p)), lambda i: F.array_min(F.slice(gs, i, reach)) == g)
            if bits is None:
                return least
            at = F.shiftright(g, 4).bitwiseAND(F.lit(n_bits - 1))
            return (F.getbit(F.element_at(bits, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1) & least

        def point(p: Column) -> Column:
            held = F.slice(words, first(p), last(p) - first(p) + length) if bits is not None else F.lit(None).cast("array<string>")
            return F.struct(F.lit(length).alias("len"), first(p).alias("first"), F.shiftright(F.element_at(gs, p), 4).alias("h"), held.alias("held"))

        return F.transform(F.filter(F.sequence(F.lit(1), F.size(gs)), wanted), point)

    grams = F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: _gram_at(words, i, k))
    # binding the grams by a one-element transform evaluates them once
    bound = F.element_at(F.transform(F.array(grams), points), 1)
    none = F.array().cast("array<struct<len:int,first:int,h:bigint,held:array<string>>>")
    return F.when(size >= length, bound).otherwise(none)


def _bloom(marks: DataFrame, count: int) -> tuple[Column, int]:
    """A bit array of 32 bits or more for each of ``count`` marks, BLOOM_BITS at most, as a literal."""
    n_bits = min(BLOOM_BITS, 1 << max(10, (32 * count).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(n_bits - 1))
    set_bits = {r["word"]: r["bits"] for r in marks.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).collect()}
    return F.from_json(F.lit(str([set_bits.get(i, 0) for i in range(n_bits // 64)])), "array<bigint>"), n_bits


def _joined(words: Column, i, length) -> Column:
    return F.array_join(F.slice(words, i, length), " ")


def _near(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def decontamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast: tuple[int, int] = (BROADCAST_MARKS, BROADCAST_WINDOWS)) -> DataFrame:
    """Contamination of each document by benchmark items.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored. A window is ``window``
    consecutive words of an item; an item of fewer, but not none, is one window. Returns doc_id, n_words, n_hit (words
    inside an occurrence of any window), n_items, items_sha256 (of the item_ids, sorted as strings and comma-joined),
    contaminated (n_hit > 0 and 20 * n_hit >= n_words) and item_ids. ``broadcast``: fingerprints and windows that may be
    broadcast.

    Null and empty texts have no words: such documents have zeros and are clean, such items have no windows. Rows that
    repeat a doc_id give one row that holds their hits together and the greatest n_words. Empty tables give no rows or
    all-clean rows. A null item_id's windows count as hits but name no item.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).select("item_id", "w", F.size("w").alias("n")).filter("n > 0")
    # at most `window` - 1 short lengths, and the full one
    lengths = sorted(r["len"] for r in items.select(F.least("n", F.lit(window)).alias("len")).distinct().collect()) or [window]
    marks = materialise(reduce(DataFrame.unionByName, [items.filter(F.col("n") >= x if x == window else F.col("n") == x).select(F.explode(_points(F.col("w"), F.col("n"), x)).alias("p")).select("p.len", "p.h") for x in lengths]).distinct())
    windows = materialise(
        items.withColumn("len", F.least("n", F.lit(window)))
        .select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("len") + 1), lambda i: _joined(F.col("w"), i, F.col("len")))).alias("gram"))
        .groupBy("gram").agg(F.collect_set("item_id").alias("ids"))
    )
    n_marks = marks.count()
    bits, n_bits = _bloom(marks, n_marks)

    # a row for each document and for each fingerprint of it that may be the benchmark's; documents' own rows have keys of
    # their own, which match nothing
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    own = F.array(F.struct(F.lit(0).alias("len"), F.lit(0).alias("first"), F.xxhash64("doc_id").alias("h"), F.lit(None).cast("array<string>").alias("held")))
    points = base.select("doc_id", "n", F.explode(F.concat(own, *[_points(F.col("w"), F.col("n"), x, bits, n_bits) for x in lengths])).alias("p")).select("doc_id", "n", "p.*")
    marked = points.join(_near(marks.withColumn("marked", F.lit(True)), n_marks, broadcast[0]), ["len", "h"], "left").filter("marked OR len = 0")
    starts = marked.select(
        "doc_id", "n", "len", "first", "h",
        F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("held") - F.col("len")), lambda j: F.struct(j.alias("j"), _joined(F.col("held"), j + 1, F.col("len")).alias("gram")))).alias("s"),
    ).select("doc_id", "n", "len", (F.col("first") + F.col("s.j")).alias("start"), F.coalesce(F.col("s.gram"), F.concat(F.lit("."), "h")).alias("gram"))
    found = starts.join(_near(windows, windows.count(), broadcast[1]), "gram", "left").filter("ids IS NOT NULL OR len = 0").select("doc_id", "n", "len", "start", "ids")

    hit = F.when(F.col("ids").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("end")))
    grouped = found.groupBy("doc_id").agg(F.max("n").cast("long").alias("n_words"), F.collect_set(hit).alias("spans"), F.collect_set("ids").alias("ids"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("sum"), F.greatest(acc["end"], s["end"]).alias("end")),
        lambda acc: acc["sum"].cast("long"),
    )
    out = grouped.select("doc_id", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("ids"))).alias("item_ids"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "item_ids",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose document isn't contaminated.

    Null doc_ids stay, since no single document is to blame. Rows that repeat a doc_id go or stay together. Null and empty
    texts are clean. Empty tables drop nothing; other columns may have any name.
    """
    return without(docs, decontamination_report(docs, items).filter("contaminated AND doc_id IS NOT NULL").select("doc_id"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("item_ids")


#: The same rows, for DuckDB.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), il AS (
  SELECT item_id, w, least(len(w), 13) AS l FROM iw WHERE len(w) > 0
), ig AS (
  SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS g FROM il
), ls AS (SELECT DISTINCT l FROM il), dg AS (
  SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS p, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS g FROM dw, ls WHERE len(w) >= l
), h AS (SELECT doc_id, p, dg.l AS l, item_id FROM dg JOIN ig ON dg.g = ig.g AND dg.l = ig.l
), hw AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM (SELECT DISTINCT doc_id, p, l FROM h)) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
