"""Tables written to the folder that the driver and all executors share, and read back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; without that, a temporary one if all runs on this machine, or an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'strandlake-checkpoints')}"
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """``df``, computed once: later plans read it, and so do tasks that run again for a lost executor. Its table goes when the
    application ends; one that is killed leaves it."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
