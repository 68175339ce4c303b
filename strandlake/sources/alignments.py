"""A store of fetched alignments, by accession, through which builds read.

The texts lie in Parquet under ``slot=/batch=``: the slot is a hash of the accession, and the batch is named by the accessions
that it adds. An alignment never changes within a release, so a write is repeated safely: a task or a caller that
does the same batch again replaces the same folders with the same rows. Of callers that add one accession at the same time in
different batches, both rows are stored and readers take that of the least batch; only keys are compared for that.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "acc string, text string, slot int, batch string"
SLOTS = 64
#: Alignments of a file, about.
FILE_ROWS = 2_000


def slot_of(acc: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(acc), F.lit(slots)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the store, or None if there is no store yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(SCHEMA).parquet(path)


def _needed(wanted: DataFrame) -> DataFrame:
    return wanted.select("acc").filter("acc IS NOT NULL").distinct().withColumn("slot", slot_of(F.col("acc")))


def _held(have: DataFrame, need: DataFrame) -> DataFrame:
    """The rows of the slots of ``need``; other folders aren't read."""
    return have.filter(F.col("slot").isin([r["slot"] for r in need.select("slot").distinct().collect()]))  # SLOTS rows at most


def add_missing(msas: DataFrame, wanted: DataFrame, path: str) -> int:
    """Adds what the store lacks of the accessions ``wanted`` (acc) from ``msas`` (acc, text), and returns how many it lacked
    there. Of several texts of one accession the greatest is stored; null accessions and null texts are none. What ``msas``
    doesn't have either is asked for again by the next call. Texts are read and shuffled once, and only missing ones."""
    have, need = stored(wanted.sparkSession, path), _needed(wanted)
    missing = need if have is None else need.join(_held(have, need).select("acc", "slot"), ["acc", "slot"], "left_anti")
    texts = msas.select("acc", "text").filter("text IS NOT NULL")
    new = texts.select("acc").distinct().join(missing, "acc", "left_semi")
    # the name is the same however the rows lie
    name = new.agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(acc))"), F.lit(0)).alias("x"), F.coalesce(F.expr("bit_xor(xxhash64(acc, 1))"), F.lit(0)).alias("y")).first()
    if not name["n"]:
        return 0
    batch = f"b{name['x'] % (1 << 64):016x}{name['y'] % (1 << 64):016x}"
    piece = F.pmod(F.xxhash64("acc", F.lit(2)), F.lit(name["n"] // (SLOTS * FILE_ROWS) + 1))
    keyed = texts.join(missing, "acc").withColumn("piece", piece).repartition("slot", "piece")
    rows = keyed.groupBy("slot", "piece", "acc").agg(F.max("text").alias("text")).select("acc", "text", "slot", F.lit(batch).alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(path)
    return name["n"]


def fetch_cached(msas: DataFrame, wanted: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """(acc, text) of the accessions in ``wanted`` (acc) that the store at ``path`` or ``msas`` has; the store gets what it lacks.
    With ``keep`` the rows are held in executors' memory too, from which Spark evicts the least recently used blocks to disk."""
    spark = wanted.sparkSession
    add_missing(msas, wanted, path)
    have = stored(spark, path)
    if have is None:
        return spark.createDataFrame([], "acc string, text string")
    need = _needed(wanted)
    have = _held(have, need)
    first = have.select("acc", "slot", "batch").join(need, ["acc", "slot"], "left_semi").groupBy("acc", "slot").agg(F.min("batch").alias("batch"))
    rows = have.join(first, ["acc", "slot", "batch"], "left_semi").select("acc", "text")
    return rows.persist(StorageLevel.MEMORY_AND_DISK) if keep else rows
