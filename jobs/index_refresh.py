"""Keeps a minimizer index up to date with a corpus that grows: each run seeds the entries that came since the last one.

    python -m jobs.index_refresh jobs/index_refresh.json --set corpus=/data/documents.parquet --set output=/data/index

A run takes the entries with ids above the high-water mark and writes, below ``output``, its own ``run=N`` folder of

- ``postings/run=N/part=P``: (seed, bucket, residual, id, ord), P the bucket's upper bits, sorted by bucket inside the files,
- ``sizes/run=N``: (bucket, n_postings), the run's share of the buckets' sizes,
- ``entries/run=N``: (id, acc, n), the entries with their lengths,

and then, as the last thing, ``marks/run=N``: the mark, and counts of what was read. A run that died before its mark is written is
run again from the mark before it, under the same number, and replaces what it left; so a run can be repeated at any time. One run at
a time. Ids must grow: an entry that comes later with an id at or below the mark would be missed, so the rows up to the mark are
counted, and a run fails (or, with ``late`` = "warn", goes on) if they are more than were read. Rows without an id are left out and
counted.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import index
from strandlake.operators.search import StoredIndex
from strandlake.sources.corpus import MIN_LEN, letters

from .common import existing, log, main, settings

DEFAULTS: dict[str, Any] = {
    "corpus": "", "format": "parquet", "output": "",
    "id": "doc_id", "text": "text", "acc": "concat('D', doc_id)",  # SQL on the corpus's columns
    "least": MIN_LEN, "most": None, "bucket_bits": index.BUCKET_BITS, "part_bits": 6, "late": "fail",
}

POSTINGS = "seed long, bucket int, residual int, id long, ord int, run int, part int"
SIZES = "bucket int, n_postings long, run int"
ENTRIES = "id long, acc string, n int, run int"


def entries_of(rows: DataFrame, conf: dict[str, Any]) -> DataFrame:
    """(id, acc, seq) of a corpus's rows: the letters of their texts."""
    return rows.select(F.expr(conf["id"]).cast("long").alias("id"), F.expr(conf["acc"]).alias("acc"), letters(F.coalesce(F.expr(conf["text"]), F.lit(""))).alias("seq"))


def marks(spark: SparkSession, output: str) -> DataFrame | None:
    return existing(spark, f"{output}/marks")


def refresh(spark: SparkSession, given: dict[str, Any]) -> dict[str, int]:
    """One run; returns what it logs: its number, and the counts of rows read and written (all 0 where nothing is new)."""
    conf = settings(DEFAULTS, given)
    out = conf["output"].rstrip("/")
    corpus = entries_of(spark.read.format(conf["format"]).load(conf["corpus"]), conf)
    done = marks(spark, out)
    last = done.agg(F.max("run").alias("run"), F.max("to_id").alias("to_id"), F.sum("n_rows").alias("n_rows"), F.max("bucket_bits").alias("bucket_bits"), F.max("part_bits").alias("part_bits")).first() if done else None
    if last and last["run"] is not None and (last["bucket_bits"], last["part_bits"]) != (conf["bucket_bits"], conf["part_bits"]):
        raise ValueError(f"the index at {out} has other bits: {last['bucket_bits']}, {last['part_bits']}")
    run, low = (last["run"] + 1, last["to_id"]) if last and last["run"] is not None else (0, None)

    before = F.lit(False) if low is None else F.col("id") <= low
    seen = corpus.agg(F.count_if(before).alias("old"), F.count_if(F.col("id").isNull()).alias("without_id"), F.count_if(F.col("id").isNotNull() & ~before).alias("n_rows"), F.max("id").alias("to_id")).first()
    late = seen["old"] - (last["n_rows"] if low is not None else 0)
    log.info("read %s: %d rows above the mark %s, %d up to it, %d without id", conf["corpus"], seen["n_rows"], low, seen["old"], seen["without_id"])
    if late > 0:
        said = f"{late} rows came with ids up to the mark {low}; they are not in the index"
        if conf["late"] != "warn":
            raise ValueError(said)
        log.warning(said)
    counts = {"run": run, "n_rows": seen["n_rows"], "n_entries": 0, "n_postings": 0, "late": max(0, late), "without_id": seen["without_id"]}
    if not seen["n_rows"]:
        log.info("nothing new; %s stays as it is", out)
        return counts

    new = corpus.filter(F.col("id").isNotNull() if low is None else F.col("id") > low)
    size = F.length("seq")
    new = new.filter((size >= conf["least"]) & (F.lit(True) if conf["most"] is None else size <= conf["most"]))
    new.select("id", "acc", size.alias("n")).write.mode("overwrite").parquet(f"{out}/entries/run={run}")
    bits = conf["bucket_bits"]
    posted = index.postings(new, bits).withColumn("part", F.shiftright("bucket", bits - conf["part_bits"]))
    # by ranges of (bucket, id): few files to a part, and a hot bucket is cut by its ids
    posted.repartitionByRange("bucket", "id").sortWithinPartitions("part", "bucket", "residual", "id").write.mode("overwrite").partitionBy("part").parquet(f"{out}/postings/run={run}")
    written = spark.read.schema(POSTINGS).parquet(f"{out}/postings/run={run}")
    index.bucket_histogram(written).sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{out}/sizes/run={run}")
    counts |= {"n_entries": spark.read.parquet(f"{out}/entries/run={run}").count(), "n_postings": written.count()}
    mark = spark.createDataFrame([(low, seen["to_id"], *(counts[c] for c in ("n_rows", "n_entries", "n_postings", "without_id")), bits, conf["part_bits"])], "from_id long, to_id long, n_rows long, n_entries long, n_postings long, without_id long, bucket_bits int, part_bits int")
    mark.coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/run={run}")
    log.info("wrote run %d to %s: %d entries, %d postings, mark %d", run, out, counts["n_entries"], counts["n_postings"], seen["to_id"])
    return counts


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    """What the runs that are marked as done have written."""
    path = path.rstrip("/")
    done = marks(spark, path)
    if done is None:
        raise ValueError(f"no index at {path}")
    runs = done.select("run", "bucket_bits", "part_bits").distinct().collect()  # a row a run
    postings, sizes, entries = (spark.read.schema(schema).parquet(f"{path}/{name}").filter(F.col("run").isin([r["run"] for r in runs])).drop("run") for name, schema in (("postings", POSTINGS), ("sizes", SIZES), ("entries", ENTRIES)))
    return StoredIndex(postings, sizes.groupBy("bucket").agg(F.sum("n_postings").alias("n_postings")), entries, runs[0]["bucket_bits"], runs[0]["part_bits"])


if __name__ == "__main__":
    main("index_refresh", "Seed the entries that a corpus gained, and add them to its index.", refresh)
