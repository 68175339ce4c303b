"""A seeded random stream of which every task draws its own part.

The generator is the 32-bit xorshift with the shifts 13, 17 and 5. A step is linear over bits, so k steps are a power of one
32 x 32 bit matrix, and the state after any number of steps is found by repeated squaring without those before it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _step(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint32(13))
    x = x ^ (x >> np.uint32(17))
    return x ^ (x << np.uint32(5))


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix, given by the images of the 32 bits, times each x."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= matrix[bit] * ((x >> np.uint32(bit)) & np.uint32(1))
    return out


@cache
def _powers() -> list[np.ndarray]:
    """The matrices of 1, 2, 4, ... 2^62 steps."""
    out = [_step(np.uint32(1) << np.arange(32, dtype=np.uint32))]
    while len(out) < 63:
        out.append(_apply(out[-1], out[-1]))
    return out


def states(seed: int, steps: np.ndarray) -> np.ndarray:
    """The generator's states after so many steps from ``seed`` (32 bits, not zero)."""
    if not 0 < seed < 1 << 32:
        raise ValueError("the seed must be between 1 and 2^32 - 1")
    steps = np.asarray(steps, "i8")
    out = np.full(len(steps), seed, np.uint32)
    for bit in range(int(steps.max(initial=0)).bit_length()):
        chosen = (steps >> bit & 1).astype(bool)
        out[chosen] = _apply(_powers()[bit], out[chosen])
    return out


def uniform(draw: Column, seed: int) -> Column:
    """The ``draw``-th number (from 0) of the stream of ``seed``, at least 0 and below 1. Null draws give null."""

    @F.pandas_udf("double")
    def run(d: pd.Series) -> pd.Series:
        known = d.notna()
        out = pd.Series(np.nan, index=d.index, dtype=object).where(known, None)
        out[known] = states(seed, d[known].to_numpy("i8") + 1) / 2.0**32
        return out.astype(object)

    return run(draw.cast("long"))
