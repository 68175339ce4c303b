"""Minimizer seeds of residue strings: over a row, without explode or shuffle.

``seeds`` is one native expression, for SQL and small inputs. Higher-order functions are interpreted a letter at a time,
so ``seed_arrays``, the same seeds by whole Arrow batches, is what the index is built with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

# The index's k-mer length, seeds aimed at, window bounds, alphabet and hash constants.
K = 10
TARGET = 12
MIN_WINDOW, MAX_WINDOW = 4, 128
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
BASE = 31
XOR, MUL_1, MUL_2 = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
_M32 = (1 << 32) - 1


def _times(a: str, c: int) -> str:
    """a * c mod 2^32 for 32-bit a: by halves, so that no product leaves 64 bits."""
    return f"(((shiftleft((shiftright({a}, 16) * {c}L) & 65535L, 16)) + ((({a}) & 65535L) * {c}L)) & {_M32}L)"


def hash32(x: str) -> list[str]:
    """The steps of the 32-bit finalizer as SQL over a variable x; each step's result is the next one's x."""
    return [f"({x} ^ {XOR}L)", _times(f"{x} ^ shiftright({x}, 16)", MUL_1), _times(f"{x} ^ shiftright({x}, 13)", MUL_2), f"(({x} ^ shiftright({x}, 16)) & 2147483647L)"]


def window_for(n: str, target: int = TARGET) -> str:
    return f"greatest({MIN_WINDOW}, least({MAX_WINDOW}, {n} div {target}))"


def seeds(seq: str, k: int = K, target: int = TARGET, w: int | None = None) -> Column:
    """Distinct seeds of column ``seq`` in block order. Blocks of w end positions have absolute phase: those that start
    at a multiple of w, from k - 1 on. K-mers with another letter have no hash. ``w`` fixes the window."""
    powers = [pow(BASE, k - 1 - j, 1 << 32) for j in range(k)]
    codes = f"transform(split({seq}, ''), c -> cast(instr('{ALPHABET}', c) - 1 as bigint))"
    at = [f"element_at(cs, i + {j + 1})" for j in range(k)]
    code = f"CASE WHEN least({', '.join(at)}) < 0 THEN NULL ELSE ({' + '.join(f'{a} * {p}L' for a, p in zip(at, powers, strict=True))}) & {_M32}L END"
    hashes = f"transform(sequence(0, size(cs) - {k}), i -> {code})"
    for step in hash32("x"):
        hashes = f"transform({hashes}, x -> {step})"
    size = str(w) if w else window_for(f"length({seq})", target)
    blocks = f"sequence(({k - 1} + {size} - 1) div {size}, (length({seq}) - 1) div {size})"
    minima = f"transform({blocks}, b -> array_min(slice(hs, b * {size} - {k - 2}, {size})))"
    body = f"element_at(transform(array(element_at(transform(array({codes}), cs -> {hashes}), 1)), hs -> array_distinct(filter({minima}, s -> s IS NOT NULL))), 1)"
    first = f"(({k - 1} + {size} - 1) div {size}) * {size}"
    return F.expr(f"CASE WHEN length({seq}) > {first} THEN {body} ELSE cast(array() as array<bigint>) END")


#: Letters that are hashed together; bounds a worker's memory, whatever the batch.
CHUNK = 2_000_000
_NONE = np.uint32(0xFFFFFFFF)
_CODES = np.full(256, 255, "u1")
_CODES[np.frombuffer(ALPHABET.encode(), "u1")] = np.arange(len(ALPHABET))


def _chunk_seeds(texts: list[bytes], k: int, target: int, w: int | None) -> list[np.ndarray]:
    """Seeds of each text. All are hashed as one run of letters: no block reads a k-mer that spans two texts."""
    size = np.array([len(t) for t in texts], "i8")
    codes = _CODES[np.frombuffer(b"".join(texts), "u1")]
    if len(codes) < k:
        return [np.zeros(0, "i8")] * len(texts)
    value = np.zeros(len(codes) - k + 1, "u4")  # arithmetic on u4 is modulo 2^32
    for j in range(k):
        value *= np.uint32(BASE)
        value += codes[j : j + len(value)]
    value ^= np.uint32(XOR)
    for shift, factor in ((16, MUL_1), (13, MUL_2)):
        value ^= value >> np.uint32(shift)
        value *= np.uint32(factor)
    value ^= value >> np.uint32(16)
    value &= np.uint32(0x7FFFFFFF)
    bad = np.concatenate([[0], np.cumsum(codes == 255)])
    value[bad[k:] > bad[: len(value)]] = _NONE
    ends = np.concatenate([np.full(k - 1, _NONE), value])  # by the k-mer's last letter

    step = np.full(len(size), w, "i8") if w else np.clip(size // target, MIN_WINDOW, MAX_WINDOW)
    first = -(-(k - 1) // step) * step
    n_blocks = np.maximum(0, -(-(size - first) // step))
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    used = np.flatnonzero(n_blocks)
    if not len(used):
        return [np.zeros(0, "i8")] * len(texts)
    counts = n_blocks[used] + 1  # the blocks, after a run that reaches from the text's first letter to them
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    cuts = np.repeat(start[used], counts) + np.where(place, np.repeat(first[used] - step[used], counts) + place * np.repeat(step[used], counts), 0)
    stop = start[used] + size[used]  # texts without a block may stand between two that have some
    bounds = np.unique(np.concatenate([cuts, stop[stop < len(ends)]]))
    least = np.minimum.reduceat(ends, bounds)[np.searchsorted(bounds, cuts)]
    owner = np.repeat(used, counts)
    keep = (place > 0) & (least != _NONE)
    owner, least = owner[keep], least[keep].astype("i8")
    once = np.sort(np.unique((owner << 31) | least, return_index=True)[1])
    return np.split(least[once], np.searchsorted(owner[once], np.arange(1, len(texts))))


def seeds_udf(k: int = K, target: int = TARGET, w: int | None = None):
    """What ``seeds`` gives, by NumPy over Arrow batches. A null sequence has no seeds."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[np.ndarray] = []
            held, total = [], 0
            for text in batch:
                raw = (text or "").encode("latin-1", "replace")
                if held and total + len(raw) > CHUNK:
                    out += _chunk_seeds(held, k, target, w)
                    held, total = [], 0
                held.append(raw)
                total += len(raw)
            if held:
                out += _chunk_seeds(held, k, target, w)
            yield pd.Series(out, dtype=object)

    return run


@F.pandas_udf(ArrayType(LongType()))
def seeds_with_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Seeds of each sequence with its own k and target. A null sequence has none."""
    for seqs, ks, targets in batches:
        out = pd.Series([np.zeros(0, "i8")] * len(seqs), dtype=object)
        for (k, target), own in pd.DataFrame({"k": ks.to_numpy(), "t": targets.to_numpy()}).groupby(["k", "t"]).indices.items():
            for i, found in zip(own, _chunk_seeds([(seqs.iat[i] or "").encode("latin-1", "replace") for i in own], int(k), int(target), None), strict=True):
                out.iat[i] = found
        yield out


def seed_arrays(seq: str, **options) -> Column:
    return seeds_udf(**options)(F.col(seq))


def seed_rows(corpus, seq: str = "seq", **options):
    """(id, ord, seed) rows of a corpus (id, seq)."""
    return corpus.select("id", F.posexplode(seed_arrays(seq, **options)).alias("ord", "seed"))
