"""Searches newly arrived chains in an index: a stream over a folder of files that ends when all that is there has been searched.

    python -m jobs.chain_search jobs/chain_search.json --set chains=/data/inbox --set index=/data/index --set output=/data/candidates

``chains`` is a folder, or a pattern of files or folders (a single file must be given as a pattern). Each batch of new files writes, below ``output``,

- ``candidates/batch=B``: (query, rank, id, acc, shared), the entries that share most seeds with each chain,
- ``lookups/batch=B``: (query, n_residues, n_seeds, seeds_skipped, candidates), a row for each chain, also for one that has no
  candidates or is too short to have seeds.

The stream's checkpoint (``output/checkpoint``) says which files have been searched. A batch that died is run again under its number and
replaces what it left. The index is one that ``index_refresh`` keeps; buckets of more than ``max_postings`` postings are passed over.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import search
from strandlake.sources.corpus import letters

from .common import log, main, settings
from .index_refresh import read_index

DEFAULTS: dict[str, Any] = {
    "chains": "", "format": "parquet", "index": "", "output": "",
    "id": "id", "text": "seq",  # SQL on the chains' columns
    "least": 40, "top_k": search.TOP_K, "max_postings": search.MAX_POSTINGS, "files_per_batch": 1000,
}


def search_new(spark: SparkSession, given: dict[str, Any]) -> dict[str, int]:
    """Search all chains that came since the last run; returns what it logs: the batches run, and rows written."""
    conf = settings(DEFAULTS, given)
    out = conf["output"].rstrip("/")
    schema = spark.read.format(conf["format"]).load(conf["chains"]).schema
    counts = {"batches": 0, "chains": 0, "candidates": 0}

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        chains = rows.select(F.expr(conf["id"]).cast("long").alias("id"), letters(F.coalesce(F.expr(conf["text"]), F.lit(""))).alias("seq")).filter("id IS NOT NULL")
        candidates, lookups, cached = read_index(own, conf["index"]).search(chains, conf["least"], conf["top_k"], conf["max_postings"])
        candidates.write.mode("overwrite").parquet(f"{out}/candidates/batch={number}")
        lookups.write.mode("overwrite").parquet(f"{out}/lookups/batch={number}")
        for x in cached:
            x.unpersist()
        n, k = (own.read.parquet(f"{out}/{x}/batch={number}").count() for x in ("lookups", "candidates"))
        log.info("batch %d: searched %d chains of %s, wrote %d candidates to %s", number, n, conf["chains"], k, out)
        counts.update(batches=counts["batches"] + 1, chains=counts["chains"] + n, candidates=counts["candidates"] + k)

    stream = spark.readStream.format(conf["format"]).schema(schema).option("maxFilesPerTrigger", conf["files_per_batch"]).load(conf["chains"])
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not counts["batches"]:
        log.info("no new files in %s; %s stays as it is", conf["chains"], out)
    return counts


if __name__ == "__main__":
    main("chain_search", "Search the chains that newly arrived files hold.", search_new)
