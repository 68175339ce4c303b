"""What the jobs share: settings, the command line, output that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(defaults: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    """``defaults`` with what is given; a setting that the job doesn't know, or one without a value, is an error."""
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = defaults | given
    missing = sorted(k for k, v in out.items() if v == "")
    if missing:
        raise ValueError(f"settings without a value: {', '.join(missing)}")
    return out


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet files at ``path``, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def main(name: str, about: str, run: Callable[[SparkSession, dict[str, Any]], Any]) -> None:
    """The command line: a settings file, and single settings that replace its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    parser.add_argument("config", help="a JSON file of settings")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting in place of the file's (JSON, or a plain text)")
    args = parser.parse_args()
    with open(args.config) as f:
        given = json.load(f)
    for pair in args.set:
        key, _, value = pair.partition("=")
        try:
            given[key] = json.loads(value)
        except json.JSONDecodeError:
            given[key] = value
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, given)
    finally:
        spark.stop()
