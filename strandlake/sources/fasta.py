"""FASTA files by byte ranges, as a data source of Spark's Python interface.

A record belongs to the range that holds its mark, a > at the start of a line. A task reads its range from the first mark in it to
the first one after it, so any cut gives each record once. With ``draws``, only windows at random places are read: a sample costs
the bytes of its windows, not those of the files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.draws import states

SPLIT_BYTES = 64 << 20
#: Bytes of a sample's window, and the letters of its sequences, as published.
WINDOW_BYTES = 1 << 20
SAMPLE_LOW, SAMPLE_HIGH = 80, 1200
SAMPLE_SEED = 20260807
#: Bytes that are read at a time behind a range's end, and letters of a batch, about.
TAIL_BYTES = 1 << 16
BATCH_LETTERS = 8 << 20


def _opened(path: str):
    """The file system of a path or address, and the path there."""
    return files_of.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (files_of.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, int]]:
    """The files of a path and their sizes, in the order of their names; hidden ones are none."""
    system, at = _opened(path)
    found = system.get_file_info(at)
    if found.type == files_of.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [found] if found.type == files_of.FileType.File else system.get_file_info(files_of.FileSelector(at, recursive=True))
    return sorted((x.path, x.size) for x in infos if x.type == files_of.FileType.File and not any(p[:1] in "._" for p in x.path[len(at) :].split("/") if p) and x.size)


@dataclass
class Range(InputPartition):
    """Bytes from ``start`` to ``stop`` of a file, of which draw number ``draw`` (or -1) chose the place."""

    path: str
    start: int
    stop: int
    draw: int = -1


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


def _records(file, at: Range, size: int) -> Iterator[bytes]:
    """The records whose marks are in the range, without their marks. Of a drawn range, those that end in it too."""
    begin = max(0, at.start - 1)
    file.seek(begin)
    held = bytearray(file.read(min(at.stop, size) - begin))
    # a mark at the range's first byte is seen with the line feed before it, which only the file's first byte hasn't
    mark = 0 if begin == at.start and held[:1] == b">" else held.find(b"\n>") + 1 or -1
    while mark >= 0:
        behind, searched = held.find(b"\n>", mark), len(held)
        while behind < 0 and at.draw < 0 and (more := file.read(TAIL_BYTES)):
            held += more
            behind, searched = held.find(b"\n>", searched - 1), len(held)
        ended = behind >= 0 or at.draw < 0 or begin + len(held) >= size
        if ended:
            yield bytes(held[mark + 1 : behind if behind >= 0 else len(held)])
        mark = behind + 1 if 0 <= behind and begin + behind + 1 < at.stop else -1


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.low, self.high = int(options.get("minlength", 0)), int(options.get("maxlength", 1 << 62))
        self.first, self.draws = int(options.get("firstdraw", 0)), int(options.get("draws", 0))
        self.seed, self.window = int(options.get("seed", SAMPLE_SEED)), int(options.get("windowbytes", WINDOW_BYTES))

    def partitions(self) -> list[InputPartition]:
        listed = _listed(self.path)
        if not self.draws:
            return [Ranges([Range(p, a, min(a + self.split, n))]) for p, n in listed for a in range(0, n, self.split)] or [Ranges([])]
        ends = np.cumsum([n for _, n in listed])
        if not len(ends):
            return [Ranges([])]
        drawn = states(self.seed, self.first + 1 + np.arange(self.draws)) / 2.0**32
        places = np.floor(drawn * max(1, int(ends[-1]) - self.window)).astype("i8")
        of = np.searchsorted(ends, places, "right")
        ranges = [Range(listed[i][0], int(a - ends[i] + listed[i][1]), min(int(a - ends[i] + listed[i][1]) + self.window, listed[i][1]), self.first + k) for k, (i, a) in enumerate(zip(of, places, strict=True))]
        step = max(1, self.split // self.window)
        return [Ranges(ranges[a : a + step]) for a in range(0, len(ranges), step)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        rows, letters = ([], [], [], [], []), 0

        def batch() -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=["header", "seq", "n", "draw", "place"])

        for at in partition.ranges:
            with system.open_input_file(at.path) as file:
                for place, record in enumerate(_records(file, at, file.size())):
                    header, _, body = record.decode("utf-8", "replace").replace("\r", "").partition("\n")
                    seq = body.replace("\n", "")
                    if not self.low <= len(seq) <= self.high:
                        continue
                    for column, value in zip(rows, (header, seq, len(seq), at.draw if at.draw >= 0 else None, place), strict=True):
                        column.append(value)
                    letters += len(header) + len(seq)
                    if letters > BATCH_LETTERS:
                        yield batch()
                        rows, letters = ([], [], [], [], []), 0
        if rows[0]:
            yield batch()


class FastaSource(DataSource):
    """``spark.read.format("fasta")``: header, seq, n (its letters), and of samples the draw and the record's place in the window.

    Options: ``path`` (a file or folder), ``minLength`` and ``maxLength`` (other sequences don't leave the reader), ``splitBytes``; for
    samples ``draws``, ``firstDraw``, ``seed`` and ``windowBytes``. Sequences may be wrapped, lines end in \\n or \\r\\n, and the last
    one needn't end. What stands before the first mark is no record. An empty file has none.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "header string, seq string, n long, draw long, place long"

    def reader(self, schema) -> FastaReader:
        return FastaReader({k.lower(): v for k, v in self.options.items()})


def scan_fasta(spark: SparkSession, path: str, accession: str = r"UA=(\S+)", low: int = 0, high: int = 1 << 62, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(acc, header, seq) as ``read_fasta`` gives them, of sequences of low to high letters."""
    spark.dataSource.register(FastaSource)
    rows = spark.read.format("fasta").option("minLength", low).option("maxLength", high).option("splitBytes", split_bytes).load(path)
    return rows.select(F.regexp_extract("header", accession, 1).alias("acc"), "header", "seq").filter("acc <> ''")


def sample_fasta(spark: SparkSession, path: str, n: int, seed: int = SAMPLE_SEED, window: int = WINDOW_BYTES, low: int = SAMPLE_LOW, high: int = SAMPLE_HIGH) -> DataFrame:
    """(draw, place, header, seq): the first n sequences of low to high standard residues in windows at the random stream's
    places, in the order of draws. Windows may overlap, so a record may come twice. Records that a window's end cuts are left out.

    Twice as many windows are drawn until there are n sequences, so that some 3 to 4 times the bytes needed are read; if all the
    windows together hold four times the files' bytes, there are fewer than n.
    """
    spark.dataSource.register(FastaSource)
    size, windows = sum(x for _, x in _listed(path)), 8
    while True:
        rows = spark.read.format("fasta").option("minLength", low).option("maxLength", high).option("draws", windows).option("seed", seed).option("windowBytes", window).load(path)
        rows = rows.filter(F.col("seq").rlike("^[ACDEFGHIKLMNPQRSTVWY]+$"))
        if windows * window >= 4 * size or rows.select("draw").limit(n).count() >= n:
            return rows.orderBy("draw", "place").select("draw", "place", "header", "seq").limit(n)
        windows *= 2
