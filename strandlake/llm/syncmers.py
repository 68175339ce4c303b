"""Document fingerprints from closed syncmers, with DataFrame functions only.

Tokens are runs of up to 16 non-blank characters (an ideograph is a token of its own). Of all windows of K tokens those
are anchors whose least inner run of S tokens stands first or last in the window. Whether a window is an anchor depends
on its own tokens alone, so an edit moves only the anchors that touch it, and of any K - S windows in a row one is an
anchor. The fingerprint holds every anchor of the text in order, with its distance in tokens from the one before, so
that anchors can be matched by place: two texts are alike in the anchors that they share at equal distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import range_bucket, range_count, range_splits, read_table, texts

TOKEN = r"\p{IsIdeographic}|[^\s\p{IsIdeographic}]{1,16}"
K = 5
S = 2
_MASK = (1 << 48) - 1


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Every anchor of a text in order, as its 48-bit hash above eight bits that hold its distance in tokens from the anchor
    before it (0 for the first; never more than k - s). A text of fewer than k tokens has one anchor, of all of them;
    one without tokens has none."""
    span = k - s

    def windows(th: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.size(th) - (s - 1)), lambda i: F.xxhash64(F.slice(th, i, s)))

        def at_edges(sm: Column) -> Column:
            def edge(i: Column) -> Column:
                return F.least(F.element_at(sm, i), F.element_at(sm, i + span)) == F.array_min(F.slice(sm, i, span + 1))

            def placed(at: Column) -> Column:
                def anchor(i: Column, n: Column) -> Column:
                    gap = F.when(n == 0, 0).otherwise(i - F.element_at(at, F.greatest(n, F.lit(1))))
                    return F.shiftleft(F.xxhash64(F.slice(th, i, k)).bitwiseAND(F.lit(_MASK)), 8).bitwiseOR(gap.cast("long"))

                return F.transform(at, anchor)

            return _let(F.filter(F.sequence(F.lit(1), F.size(th) - (k - 1)), edge), placed)

        one = F.array(F.shiftleft(F.xxhash64(th).bitwiseAND(F.lit(_MASK)), 8))
        return F.when(F.size(th) >= k, _let(inner, at_edges)).when(F.size(th) > 0, one).otherwise(F.array().cast("array<bigint>"))

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return _let(F.transform(tokens, lambda t: F.xxhash64(t)), windows)


def written(found: Column) -> Column:
    """Anchors as text: 12 hexadecimal digits and the distance each, space-joined; empty without anchors."""
    return F.array_join(F.transform(found, lambda a: F.concat(F.lpad(F.lower(F.hex(F.shiftright(a, 8))), 12, "0"), a.bitwiseAND(F.lit(255)).cast("string"))), " ")


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text as text. Equal texts have equal fingerprints."""
    return written(anchors(text, k, s))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' distinct anchors, matched by hash and distance from the anchor before: 1 for equal
    ones (none on both sides, too), 0 if just one text has any."""

    def of(x: Column) -> Column:
        shared = F.size(F.array_intersect(x["a"], x["b"]))
        return shared / (F.size(F.array_distinct(x["a"])) + F.size(F.array_distinct(x["b"])) - shared)

    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_let(F.struct(a.alias("a"), b.alias("b")), of))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document beside the next one in descending doc_id (after the last: the first): adds fp (its anchors), next_text and next_fp.

    Documents are dealt to ranges of doc_id; each range also gets the first row of the range below it (the lowest one:
    of the highest), so that a window inside the range sees every successor. Rows of equal doc_id go by text,
    descending; null doc_ids come last.
    """
    placed = docs.withColumn("bucket", range_bucket(F.col("doc_id"), range_splits(docs, "doc_id", range_count(docs))))
    tops = placed.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # a row for each range
    order = Window.orderBy("bucket")
    heads = tops.select(F.coalesce(F.lag("top").over(order), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("doc_id"), "bucket")
    ghosts = docs.join(F.broadcast(heads), "doc_id").withColumn("ghost", F.lit(1))
    rows = placed.withColumn("ghost", F.lit(0)).unionByName(ghosts).withColumn("fp", anchors(F.col("text")))
    down = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc(), F.col("text").desc())
    follow = rows.withColumn("next_text", F.lead("text").over(down)).withColumn("next_fp", F.lead("fp").over(down))
    return follow.filter("ghost = 0").withColumns({"next_text": F.coalesce("next_text", "text"), "next_fp": F.coalesce("next_fp", "fp")}).drop("ghost", "bucket")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Returns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next. A null text is
    empty; empty texts have empty fingerprints. Rows of equal doc_id follow each other by text, descending; null doc_ids
    come last. A table of one row is followed by itself; an empty one gives no rows.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    paired = with_next(texts(docs)).select(
        "doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited_text"),
    ).withColumn("edited_fp", anchors(F.col("edited_text")))
    return paired.select(
        "doc_id", "n_chars", "edited_text", written(F.col("fp")).alias("fingerprint"), written(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_pairs(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
