"""The jobs as registered queries: each runs twice over the whole tables into a new folder, and returns the output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.functions.store import shared_dir
from strandlake.plans.queries import CORPUS_SEEDS, seed_sql

from .chain_search import search_new
from .index_refresh import read_index, refresh


def job1_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents: the second run finds nothing new."""
    conf = {"corpus": f"{sf_dir}/documents.parquet", "output": shared_dir(spark)}
    for _ in range(2):
        refresh(spark, conf)
    return read_index(spark, conf["output"]).postings


def job2_chain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations, searched in an index of all documents: the second run finds no new files."""
    out = shared_dir(spark)
    refresh(spark, {"corpus": f"{sf_dir}/documents.parquet", "output": f"{out}/index"})
    for _ in range(2):
        search_new(spark, {"chains": f"{sf_dir}/conversations.parquet*", "index": f"{out}/index", "output": f"{out}/found", "id": "conv_id * 1000 + turn", "text": "text"})
    return spark.read.parquet(f"{out}/found/candidates").drop("batch")


QUERIES = {"job1_index_refresh": job1_index_refresh, "job2_chain_search": job2_chain_search}

_TURNS = seed_sql("SELECT conv_id * 1000 + turn AS id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM conversations WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 40", "i")
ORACLE = {
    "job1_index_refresh": f"WITH {CORPUS_SEEDS} SELECT seed, CAST(seed >> 6 AS INTEGER) AS bucket, CAST(seed & 255 AS INTEGER) AS residual, id, ord, CAST(seed >> 25 AS INTEGER) AS part FROM s",
    "job2_chain_search": f"""WITH {CORPUS_SEEDS}, {_TURNS}, sz AS (SELECT seed >> 6 AS bucket FROM s GROUP BY 1 HAVING count(*) <= 20000),
p AS (SELECT x.id AS query, y.id AS id, count(*) AS shared, min(x.ord) AS first_ord FROM i x JOIN sz ON sz.bucket = x.seed >> 6 JOIN s y ON x.seed >> 6 = y.seed >> 6 AND x.seed & 255 = y.seed & 255 GROUP BY 1, 2)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY shared DESC, first_ord, id) AS INTEGER) AS rank, id, 'D' || id AS acc, shared FROM p QUALIFY rank <= 20""",
}
