"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space that the contracts strip or split at: space, \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"


class _Held(threading.local):
    """The folders written inside each open ``scratch`` of a driver thread: queries in other threads have their own."""

    def __init__(self) -> None:
        self.stack: list[list[str]] = []


_HELD = _Held()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (other columns, whatever their names, go); a null text reads as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose doc_id isn't in ``doc_ids`` (one column); null doc_ids stay."""
    gone = fresh(docs, "gone")
    return docs.join(doc_ids.toDF(gone), F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. All-ASCII values take the byte-wise built-in; others map the 26 letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see, under ``spark.checkpoint.dir`` of the session. Where that is
    unset, a temporary folder is taken if the session runs on this machine alone, and else an error raised."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'strandlake-checkpoints')}"
    return f"{base.rstrip('/')}/strandlake/{uuid.uuid4().hex}"


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if _HELD.stack:
        _HELD.stack[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes what ``materialise`` wrote inside. The function that it gives takes the result, and leaves the folders that
    the result still reads: they go to the scratch around this one, if any, and else stay for the caller to read."""
    held: list[str] = []
    kept: list[str] = []
    _HELD.stack.append(held)

    def result(out: DataFrame) -> DataFrame:
        files = out.inputFiles()
        kept.extend(p for p in held if any(os.path.basename(p) in f for f in files))
        return out

    try:
        yield result
    finally:
        _HELD.stack.pop()
        for path in held:
            if path not in kept:
                remove(spark, path)
        if _HELD.stack:
            _HELD.stack[-1].extend(kept)


#: Input bytes of a range, about, and ranges at most.
RANGE_BYTES = 128 << 20
MOST_RANGES = 20_000


def range_count(df: DataFrame) -> int:
    """Ranges to deal ``df`` to: by its estimated size, if known, and no fewer than the shuffle's partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = 0 if size >= 1 << 60 else size  # Spark's size of what it can't estimate
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, known // RANGE_BYTES))


def range_splits(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending split points of an integer key (bounded driver state)."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, at, max(10_000, 4 * parts)).alias("s")).first()["s"]
    return sorted({int(x) for x in got}) if got else []


def range_bucket(key: Column, splits: list[int]) -> Column:
    """The number of split points below ``key``: monotone in it. A null key is in bucket 0. A row is compared with some
    square root of the points."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits) - 1) + 1

    def below(points: Column) -> Column:
        return F.coalesce(F.size(F.filter(points, lambda x: x < key)), F.lit(0))

    all_of, each = (F.from_json(F.lit(str(x)), "array<bigint>") for x in (splits, splits[step - 1 :: step]))
    coarse = below(each) * step
    return coarse + below(F.slice(all_of, coarse + 1, F.lit(step)))
