"""Mixture-controlled packing of token ids into fixed windows.

Sources are queues of tokens. Deficit round-robin serves, token by token, the queue that lags most behind its share:
the q-th token of queue j is due at the virtual time (q + 1/2) / total_j, and tokens are served in that order. How much
of each queue a window's end has seen is then a function of the window's number and the queue totals alone
(``Mixture.served``), so any executor can place any document's ids without the windows before it: the deficits carried
across windows and partitions are in the formula. Every window holds each source in proportion, within a token or so.

A window can't hold a token of each of very many sources. Beyond MAX_QUEUES, sources share queues, and inside a shared
queue chunks of at most a window's tokens are served in the same order, by the virtual times of their middles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

LENGTH = 2048
END_ID = 1
#: Queues at most; with more sources than that, sources share queues by hash.
MAX_QUEUES = 1024
#: Rows of shared queues that are sorted together, about.
SLICE_ROWS = 100_000


class Mixture:
    """Where the windows' ends stand in every queue. ``shares``: the queues' target proportions, or None for their own."""

    #: Numbers of a table that is held at a time.
    cells = 1_000_000

    def __init__(self, totals: list[int], length: int = LENGTH, shares: list[float] | None = None) -> None:
        self.totals = np.array(totals, "i8")
        self.length = length
        self.all = int(self.totals.sum())
        self.shares = np.array(totals if shares is None else shares, "f8")
        if (self.shares[self.totals > 0] <= 0).any():
            raise ValueError("a source's share must be positive")
        self.shares = np.where(self.totals > 0, self.shares / max(self.shares[self.totals > 0].sum(), 1e-300), 1.0)
        # queues in the order in which they run out: until when, and the tokens served by then
        over = self.totals / self.shares
        turn = np.argsort(over, kind="stable")
        self.over = over[turn]
        self.gone = np.r_[0, np.cumsum(self.totals[turn])].astype("f8")
        live = np.where(self.totals > 0, self.shares, 0.0)[turn]
        self.rate = np.r_[live[::-1].cumsum()[::-1], 0.0]
        self.by = self.gone[:-1] + self.over * self.rate[:-1]
        self.full, rest = divmod(self.all, length)
        ends = [self.full * length]
        for bit in reversed(range(rest.bit_length())):  # the rest needs no padding: sequences of powers of two
            if rest >> bit & 1:
                ends.append(ends[-1] + (1 << bit))
        self.tail = np.array(ends, "i8")
        self.count = self.full + len(ends) - 1

    def end(self, sequence: np.ndarray) -> np.ndarray:
        """Tokens before each sequence."""
        return np.where(sequence <= self.full, sequence * self.length, self.tail[np.clip(sequence - self.full, 0, len(self.tail) - 1)])

    def time(self, tokens: np.ndarray) -> np.ndarray:
        """The virtual time at which about so many tokens have been served."""
        k = np.minimum(np.searchsorted(self.by, tokens, "left"), len(self.over) - 1)
        return np.where(self.rate[k] > 0, (tokens - self.gone[k]) / np.where(self.rate[k] > 0, self.rate[k], 1), self.over[k])

    def rank(self, time: np.ndarray) -> np.ndarray:
        """About how many tokens have been served by a virtual time: half a token in each queue more or less."""
        k = np.searchsorted(self.over, time, "left")
        return self.gone[k] + time * self.rate[k]

    def served(self, tokens: np.ndarray) -> np.ndarray:
        """A row for each number of tokens: how many of them each queue gave, those due first, ties by queue."""
        w, share = self.totals[None, :], self.shares[None, :]
        a = np.clip(np.floor(self.time(tokens)[:, None] * share + 0.5).astype("i8"), 0, w)
        while True:
            last = np.where(a > 0, (2 * a - 1) / (2 * share), -np.inf)
            due = np.where(a < w, (2 * a + 1) / (2 * share), np.inf)
            out = last.shape[1] - 1 - last[:, ::-1].argmax(1)
            into = due.argmin(1)
            row = np.arange(len(a))
            x, y = last[row, out], due[row, into]
            short = tokens - a.sum(1)
            swap = (short == 0) & ((x > y) | ((x == y) & (out > into)))
            if not (short.any() or swap.any()):
                return a
            np.add.at(a, (row[(short > 0) | swap], into[(short > 0) | swap]), 1)
            np.add.at(a, (row[(short < 0) | swap], out[(short < 0) | swap]), -1)

    def _touched(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs, and for each the sequences that may hold tokens of it, by the ranks of tokens half a sequence apart or less: no
        more sequences than a few times its tokens, however many lie between its first and last."""
        stride = np.maximum(1, (self.shares * self.length / 2).astype("i8"))[queue]
        count = np.where(size > 0, (size - 1) // stride + 2, 0)
        run = np.repeat(np.arange(len(queue)), count)
        place = (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)) * stride[run]
        place = start[run] + np.minimum(place, size[run] - 1)
        rank = self.rank((place + 0.5) / self.shares[queue][run])
        guess = np.where(rank >= self.tail[0], self.full + np.searchsorted(self.tail[1:], rank, "right"), rank // self.length).astype("i8")
        new = np.r_[True, (run[1:] != run[:-1]) | (guess[1:] != guess[:-1])] if len(run) else np.zeros(0, bool)
        run, guess = run[new], guess[new]
        slack = 2 + len(self.totals) // self.length
        near = (guess[:, None] + np.arange(-slack, slack + 1)).ravel()
        by_tail = np.flatnonzero(guess >= self.full - slack)  # short sequences: any of them
        ends = np.arange(self.full, self.count)
        run = np.r_[np.repeat(run, 2 * slack + 1), np.repeat(run[by_tail], len(ends))]
        near = np.r_[near, np.tile(ends, len(by_tail))]
        own = (near >= 0) & (near < self.count)
        pairs = np.unique(run[own] * (self.count + 1) + near[own])
        return pairs // (self.count + 1), pairs % (self.count + 1)

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut runs [start, start + size) of queues at the windows: run, first position in the run, length, sequence, offset."""
        runs, sequences = self._touched(queue, start, size)
        found = []
        for at in range(0, len(runs), step := max(1, self.cells // max(1, len(self.totals)))):
            run, sequence = runs[at : at + step], sequences[at : at + step]
            marks = np.unique(np.concatenate([sequence, sequence + 1]))
            table = self.served(self.end(marks))
            low, high = table[np.searchsorted(marks, sequence)], table[np.searchsorted(marks, sequence + 1)]
            row, j = np.arange(len(run)), queue[run]
            begin, stop = np.maximum(low[row, j], start[run]), np.minimum(high[row, j], start[run] + size[run])
            given = (high - low).cumsum(1)
            offset = given[row, j] - (high[row, j] - low[row, j]) + begin - low[row, j]
            k = np.flatnonzero(stop > begin)
            found.append((run[k], (begin - start[run])[k], (stop - begin)[k], sequence[k], offset[k]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, "i8"),) * 5


def _encoded(path: str, end_id: int, most: int | None):
    """Rows of at most ``most`` ids of a document: ``skip`` of its ``whole`` ids lie before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from .bpe import Encoder, small_batches

        encoder, part, seen = Encoder.of(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for cut in small_batches(batch["text"].str.len().tolist()):
                rows = batch.iloc[cut]
                ids = [x + end for x in encoder.encode(rows["text"].tolist())]
                row, skip, starts, chunks = [], [], [], []
                for i, (q, x) in enumerate(zip(rows["queue"], ids, strict=True)):
                    for at in range(0, len(x), 4 * most if most else len(x)):
                        chunks.append(x[at : at + 4 * most] if most else x)
                        row.append(i)
                        skip.append(at // 4)
                        starts.append(seen.get(q, 0))
                        seen[q] = starts[-1] + len(chunks[-1]) // 4
                of = rows.iloc[row].reset_index(drop=True)
                yield pd.DataFrame({"doc_id": of["doc_id"], "queue": of["queue"], "part": part, "within": starts, "n": [len(x) // 4 for x in chunks], "skip": skip, "whole": [len(ids[i]) // 4 for i in row], "ids": [_narrow(x) for x in chunks]})

    return run


def _narrow(ids: bytes) -> bytes:
    """Ids in the fewest of 2 or 4 bytes each, after a byte that tells which."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\x04" + ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, f"<u{ids[0]}", offset=1).astype("<u4")


def _in_shared_queues(encoded: DataFrame, parts: DataFrame) -> DataFrame:
    """``encoded`` with shared queues in place of its own and each row's place there: by the virtual time of its middle, which
    is the share of its source's tokens before that. Times are spread evenly, so slices of them are of like size, whatever
    the queue; only rows without ids are sorted."""
    mine = Window.partitionBy("queue")
    of = parts.select("queue", "part", F.coalesce(F.sum("total").over(mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("total").over(mine).alias("own"))
    slices = encoded.count() // SLICE_ROWS + 1
    due = (F.col("base") + F.col("within") + F.col("n") / 2) / F.col("own")
    shared = F.pmod(F.xxhash64("queue"), F.lit(MAX_QUEUES)).cast("string")
    rows = encoded.select("queue", "part", "within", "n").join(of, ["queue", "part"]).select("queue", "part", "within", "n", due.alias("due"), shared.alias("shared"))
    rows = rows.withColumn("slice", F.least(F.floor(F.col("due") * slices), F.lit(slices - 1)))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("shared", "slice").agg(F.sum("n").alias("total"))
    bases = sums.select("shared", "slice", F.coalesce(F.sum("total").over(upto.partitionBy("shared").orderBy("slice")), F.lit(0)).alias("base"))
    near = F.coalesce(F.sum("n").over(upto.partitionBy("shared", "slice").orderBy("due", "queue", "part", "within")), F.lit(0))
    placed = rows.withColumn("near", near).join(bases, ["shared", "slice"]).select("queue", "part", "within", "shared", (F.col("base") + F.col("near")).alias("place"))
    return encoded.join(placed, ["queue", "part", "within"]).withColumn("queue", F.col("shared"))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pack every document's ids, with ``end_id`` after each, into sequences of ``length``.

    ``docs`` needs doc_id, text and source; ``tokenizer`` is the path of a tokenizers file. Returns a row for each
    piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with ``with_ids``). Each id lies in
    one piece; all sequences are full, but that the rest is cut into sequences of powers of two.

    Every window holds the sources in the proportions of ``targets`` (source: weight; a source without one has the weight 1),
    as long as they last, or else in those of the corpus.

    Null and empty texts are the end id alone. A null source is a source like any other. Rows that repeat a doc_id are
    packed each on its own. An empty table gives no rows. Queues go by the order of the rows in the table. With more than
    MAX_QUEUES sources, which allow no targets, sources that share a queue keep their proportions in any stretch of it within
    ``length`` tokens each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("queue"))
    crowded = rows.select("queue").distinct().limit(MAX_QUEUES + 1).count() > MAX_QUEUES
    if crowded and targets:
        raise ValueError(f"targets are for at most {MAX_QUEUES} sources")
    schema = "doc_id long, queue string, part int, within long, n long, skip long, whole long, ids binary"
    encoded = materialise(rows.mapInPandas(_encoded(tokenizer, end_id, length if crowded else None), schema))
    parts = encoded.groupBy("queue", "part").agg(F.sum("n").alias("total"))
    if crowded:
        placed = _in_shared_queues(encoded, parts)
        queues = encoded.groupBy(F.pmod(F.xxhash64("queue"), F.lit(MAX_QUEUES)).cast("string").alias("queue")).agg(F.sum("n").alias("total")).collect()
    else:
        upto = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = parts.select("queue", "part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))  # a row for each queue and input split
        queues = parts.groupBy("queue").agg(F.sum("total").alias("total"), F.count("*").alias("parts")).collect()
        near = sum(r["parts"] for r in queues) <= 1_000_000
        placed = encoded.join(F.broadcast(bases) if near else bases, ["queue", "part"]).withColumn("place", F.col("base") + F.col("within"))
    totals = {r["queue"]: r["total"] for r in queues}  # MAX_QUEUES rows at most
    names = sorted(totals)
    weights = {"" if s is None else f"s{s}": w for s, w in (targets or {}).items()}
    mixture, number = Mixture([totals[q] for q in names], length, [weights.get(q, 1.0) for q in names] if targets else None), {q: i for i, q in enumerate(names)}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .bpe import small_batches

        for batch in (whole.iloc[c] for whole in batches for c in small_batches(whole["n"].tolist(), 500_000)):
            queue = batch["queue"].map(number).to_numpy("i8")
            run, first, size, sequence, offset = mixture.pieces(queue, batch["place"].to_numpy("i8"), batch["n"].to_numpy("i8"))
            raw, parts_of, crc, at = batch["ids"].tolist(), [], [], -1
            for r, f, n in zip(run.tolist(), (4 * first).tolist(), (4 * (first + size)).tolist(), strict=True):
                if r != at:
                    at, ids = r, memoryview(_wide(raw[r])).cast("B")
                crc.append(zlib.crc32(ids[f:n]))
                if with_ids:
                    parts_of.append(ids[f:n].cast("I").tolist())
            docs_of = batch["doc_id"]
            docs_of = docs_of.to_numpy("i8")[run] if docs_of.notna().all() else docs_of.astype("Int64").to_numpy(dtype=object)[run]
            out = pd.DataFrame({"doc_id": docs_of, "start": batch["skip"].to_numpy("i8")[run] + first, "length": size, "ids_crc32": np.array(crc, "i8"), "doc_tokens": batch["whole"].to_numpy("i8")[run], "sequence_id": sequence, "offset": offset})
            yield out.assign(ids=parts_of) if with_ids else out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return placed.select("doc_id", "queue", "place", "n", "skip", "whole", "ids").mapInPandas(cut, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
