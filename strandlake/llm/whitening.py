"""Embedding whitening by a covariance in two passes.

Entries become integers, so the sums of the first pass are exact. The second sums the outer products of centred vectors, a matrix
product for each Arrow batch; partial sums are merged in a tree of tasks, and the driver holds one matrix of the vectors' dimension.
Its eigenvectors, a few columns, go to all tasks, which project the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries of more magnitude have no exact integer here and count as not finite.
LARGEST = float(1 << 37)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_SAFE = 1 << 62


def integers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, their integer vectors) of a batch (vec_id, embedding), for each length of vector in it. Null vectors and those
    with null or non-finite entries are left out."""
    column = batch.column(1)
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lengths = np.asarray(column.drop_null().value_lengths().to_numpy(zero_copy_only=False), "i8")
    values = column.flatten().to_numpy(zero_copy_only=False).astype("f8")  # a null entry is not a number
    bad = ~(np.abs(values) <= LARGEST)
    ends = np.cumsum(lengths)
    upto = np.concatenate([[0], np.cumsum(bad)])
    good = upto[ends] == upto[ends - lengths]
    for size in np.unique(lengths[good]):
        own = np.flatnonzero(good & (lengths == size))
        at = (ends[own] - size)[:, None] + np.arange(size)
        yield rows[own], np.floor(SCALE * values[at]).astype("i8") + SHIFT


def _merged(df: DataFrame, partial: Callable, schema: str, read: Callable, merge: Callable) -> Any:
    """One value from all partitions: ``partial`` makes rows of a partition's batches, ``read`` a value of a row, and ``merge`` one of
    two; merged in a tree of tasks. None without rows."""
    return df.mapInArrow(partial, schema).rdd.map(read).treeAggregate(None, lambda a, b: b if a is None else merge(a, b), lambda a, b: b if a is None else a if b is None else merge(a, b))


@dataclass
class Whitening:
    """A fitted projection: the number of vectors, their exact sums, and components with their variances, most first."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    axes: np.ndarray  # a column for each component

    @property
    def held(self) -> np.ndarray:
        """Which components have a variance beyond rounding."""
        return self.values > len(self.sums) * np.finfo("f8").eps * (self.values[0] if len(self.values) else 0)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n times the vectors minus the sums, exact, and the same divided by n."""
        far = max(self.n * int(np.abs(x).max(initial=0)), max(map(abs, self.sums), default=0))
        exact = x * self.n - np.array(self.sums, "i8") if 2 * far < _SAFE else x.astype(object) * self.n - np.array(self.sums, object)
        return exact, exact.astype("f8") / self.n

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.held, centred @ self.axes / np.sqrt(np.where(self.held, self.values, 1)), np.nan)


def _two(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def column_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors of the commonest length (of equal ones, the greatest), and the exact sums of their integers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for rows, x in integers(batch):
                n, sums = found.get(x.shape[1], (0, [0] * x.shape[1]))
                found[x.shape[1]] = [n + len(rows), [a + int(b) for a, b in zip(sums, x.sum(0), strict=True)]]
        if found:
            yield pa.RecordBatch.from_pydict({"size": list(found), "n": [n for n, _ in found.values()], "sums": [",".join(map(str, s)) for _, s in found.values()]}, pa.schema([("size", pa.int64()), ("n", pa.int64()), ("sums", pa.string())]))

    def read(row) -> dict:
        return {row["size"]: (row["n"], [int(x) for x in row["sums"].split(",") if x])}

    def merge(a: dict, b: dict) -> dict:
        return a | {k: (n + a[k][0], [x + y for x, y in zip(sums, a[k][1], strict=True)]) if k in a else (n, sums) for k, (n, sums) in b.items()}

    found = _merged(_two(vectors), partial, "size long, n long, sums string", read, merge) or {0: (0, [])}
    return found[max(found, key=lambda k: (found[k][0], k))]


def _outer(vectors: DataFrame, size: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over vectors of ``size`` entries of the outer product of what ``rows_of`` makes of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in integers(batch):
                if x.shape[1] == size:
                    c = rows_of(x)
                    total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]}, pa.schema([("sums", pa.binary())]))

    flat = _merged(_two(vectors), partial, "sums binary", lambda row: np.frombuffer(bytes(row["sums"]), "f8"), lambda a, b: a + b)
    return None if flat is None else flat.reshape(int(len(flat) ** 0.5 + 0.5), -1)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The components of most variance of ``vectors`` (vec_id, embedding)."""
    n, sums = column_sums(vectors)
    shape = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((len(sums), 0)))
    products = _outer(vectors, len(sums), lambda x: shape.centred(x)[1]) if sums else None
    if products is None:
        return shape
    covariance = products / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = np.maximum(values[::-1][:components], 0), axes[:, ::-1][:, :components]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])  # the entry of most magnitude is positive
    return Whitening(n, sums, float(np.trace(covariance)), values, axes * signs)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry, by magnitude, of the covariance of the whitened vectors minus the identity; measured on all of them. Components
    without variance don't count; 0 if none has any."""
    held = model.held
    products = _outer(vectors, len(model.sums), lambda x: model.whitened(model.centred(x)[1])[:, held]) if held.any() else None
    return 0.0 if products is None else float(np.abs(products / model.n - np.eye(int(held.sum()))).max())


def project(vectors: DataFrame, model: Whitening, error: float) -> DataFrame:
    """The rows of SCHEMA for each vector and component."""
    schema, size, k = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]), len(model.sums), len(model.values)
    shares = model.values / model.trace if model.trace > 0 else np.zeros(k)
    shared = vectors.sparkSession.sparkContext.broadcast((model, shares))  # a few columns of the vectors' dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shares = shared.value
        for batch in batches:
            for rows, x in integers(batch):
                if x.shape[1] != size or not k:
                    continue
                exact, centred = model.centred(x)
                if exact.dtype == object or size * float(np.abs(exact).max(initial=0)) ** 2 >= _SAFE:
                    squares = [sum(int(v) ** 2 for v in row) for row in exact]
                    squares = [s if s < 1 << 63 else None for s in squares]
                else:
                    squares = (exact * exact).sum(1)
                ids, w = batch.column(0).take(pa.array(rows)), model.whitened(centred)
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(rows))), pa.array(np.full(len(rows) * k, model.n, "i8")), pa.array(squares, pa.int64()).take(each),
                    pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(shares, len(rows))), pa.array(np.full(len(rows) * k, error)),
                ], schema=schema)

    return _two(vectors).mapInArrow(run, SCHEMA)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows of SCHEMA for ``vectors`` (vec_id, embedding): each vector on the components of most variance, over their deviation.

    An entry c stands for floor(1024 c) + 100000. Null vectors and those with null or non-finite entries (or of more than LARGEST in
    magnitude) give no rows and aren't learned from; nor are vectors of another length than the commonest, of equally common
    ones the longest. Rows that repeat a vec_id, or have none, each count and give rows. A component without variance has null
    ``whitened`` and no part in ``identity_error``; ``deviation`` is null where it exceeds a long. Without vectors, or if theirs are
    empty, there are no rows. Other columns, whatever their names, aren't looked at."""
    model = fit(vectors, components)
    return project(vectors, model, identity_error(vectors, model))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
