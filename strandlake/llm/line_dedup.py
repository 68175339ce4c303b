"""Corpus-wide line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, fresh, materialise, own_columns, read_table

MIN_CHARS = 20
MIN_DOCS = 3


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop lines that repeat across documents.

    A line's key is the line stripped of white space with A-Z lower-cased. Keys of at least ``min_chars`` code points
    found in at least ``min_docs`` documents lose all their lines except in the largest doc_id that holds them. Returns
    doc_id, n_lines, n_dropped, kept_text. Only 128-bit hashes of keys are shuffled, with counts pre-aggregated, so a
    line that a third of all documents hold is one small row from each task.

    A null or empty text is one empty line, which stays. Rows that repeat a doc_id are one document, but each row loses
    the lines of its own text. A null doc_id counts as a document for each row, is never the largest, and loses no
    lines. An empty table gives no rows.
    """
    rows, (n_lines, n_dropped, kept) = with_kept_text(docs.select("doc_id", "text"), min_chars, min_docs)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.col(kept).alias("kept_text"))


def with_kept_text(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, list[str]]:
    """The rows of ``docs`` with their own columns, whatever their names, and three more, whose names are returned: lines,
    dropped lines, kept text."""
    names = [fresh(docs, c) for c in ("n_lines", "n_dropped", "kept_text", "lines", "md5", "kept", "doc", "same", "gone")]
    n_lines, n_dropped, kept_text, lines, md5, kept, of_doc, of_same, gone = names
    doc, text = F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text"), F.lit(""))
    same = F.unhex(F.md5(text))
    keyed = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(_key(x).alias("key"), i.alias("pos")))
    long_ones = F.transform(F.filter(keyed, lambda s: F.char_length(s["key"]) >= min_chars), lambda s: F.struct(F.unhex(F.md5(s["key"])).alias("key"), s["pos"].alias("pos")))
    held = docs.select(doc, same.alias("same"), long_ones.alias("held"))
    in_docs = held.select("doc", F.explode(F.array_distinct(F.transform("held", lambda s: s["key"]))).alias("key")).groupBy("key", "doc").agg(F.count("*").alias("n"))
    counts = in_docs.groupBy("key").agg(F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(1)).alias("n"), F.max("doc").alias("keeper"))
    common = materialise(counts.filter(F.col("n") >= min_docs).select("key", "keeper"))
    # rows of one doc_id and one text lose the same lines
    dropped = (
        held.select("doc", "same", F.explode("held").alias("s")).select("doc", "same", "s.key", "s.pos")
        .join(common, "key").filter("doc <> keeper")
        .groupBy(F.col("doc").alias(of_doc), F.col("same").alias(of_same)).agg(F.collect_set("pos").alias(gone))
    )
    joined = docs.withColumns({lines: F.split(text, "\n", -1), md5: same}).join(dropped, (F.col("doc_id").cast("long") == F.col(of_doc)) & (F.col(md5) == F.col(of_same)), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(gone, F.array().cast("array<int>")))
    joined = joined.select(*own_columns(docs), lines, stay.alias(kept))
    out = joined.select(
        *own_columns(docs), F.size(lines).cast("long").alias(n_lines), (F.size(lines) - F.size(kept)).cast("long").alias(n_dropped),
        F.array_join(F.transform(kept, lambda p: F.element_at(lines, p + 1)), "\n").alias(kept_text),
    )
    return out, [n_lines, n_dropped, kept_text]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same rows, for DuckDB.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT k.doc_id, k.pos, k.line, (c.key IS NOT NULL AND c.keeper <> k.doc_id) AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
