"""The corpus pipeline: quality, line dedup, near dedup, decontamination, packing.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import materialise, own_columns, read_table, scratch
from strandlake.llm.decontaminate import drop_contaminated
from strandlake.llm.line_dedup import with_kept_text
from strandlake.llm.near_dedup import keep_one_of_each
from strandlake.llm.pack import pack_documents
from strandlake.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on them, rejects go. Null and empty texts are scored like any other, and rows
    that repeat a doc_id each on their own; an empty table stays empty."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text. A document stays even if nothing of it does: near dedup and packing
    have defined results for empty texts. Each row keeps what is left of its own text, also where doc_ids are null or
    repeat; a null text becomes empty."""
    rows, (_, _, kept) = with_kept_text(docs)
    new = {"text": F.col(kept), "n_chars": F.char_length(kept).cast("long")}
    return rows.select(*[new[name].alias(name) if name in new else c for name, c in zip(docs.columns, own_columns(docs), strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, and one row of it. Rows with a null doc_id and rows of blank texts
    belong to no group and stay; an empty table stays empty."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go, with all rows of their doc_id. Null and empty texts are clean, and rows
    with a null doc_id stay; without documents or items nothing goes."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences. A null or empty text is its end id alone, a null source a source like any other, rows
    that repeat a doc_id are packed each on its own, and an empty table gives no pieces."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can't express a trained classifier or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as result:
        docs = read_table(spark, sf_dir, "documents")
        for i, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs if i == 0 else materialise(docs), sf_dir)
        return result(docs)
