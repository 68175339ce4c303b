"""Token counts without ids: pieces are counted once for each distinct pre-token of the corpus.

The sentencepiece model has no piece with its space mark after another character and none with a line feed, so no merge
crosses the start of a run of spaces or a line feed. A text therefore has as many pieces as its pre-tokens (a run of
spaces with what follows up to the next, or a line feed) have, however they stand.

Documents are read in blocks. A block is written as the list of its distinct pre-tokens and each document's frequencies
by place in that list. The list goes by a hash's bucket, then by pre-token, and a bucket's part of it is shuffled as one
text; what tells its pre-tokens' places is where the part starts. Where all parts of a bucket meet, they are split and
sorted by pre-token; the pieces of each distinct one are counted, once, and go back to the places that hold it, where
they are joined to the frequencies and summed. A pre-token that all documents hold is one row of each block among its
many thousands, so no key is hot, and no group is held in memory.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, range_count, read_table, scratch, texts

LIMIT = 4096
SPACE = "▁"
#: Code points of a block, about.
BLOCK_CHARS = 16_000_000
#: Buckets of pre-tokens for each range that the input is dealt to.
BUCKETS = 4
#: Rows of lists whose counts go out together.
TOGETHER = 200_000
_PRE = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_LOADED: dict[str, PieceCounter] = {}


class PieceCounter:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        # the argument above holds for this model, and for no other that isn't so: there, a text is one pre-token
        self.separable = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) and self.model.encode(" \n", out_type=str)[0] == SPACE * 2

    @classmethod
    def of(cls, path: str) -> PieceCounter:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def frequencies(self, text: str) -> Counter:
        if not text:
            return Counter()
        return Counter(_PRE.findall(SPACE + text.replace(" ", SPACE))) if self.separable else Counter([text])

    def pieces(self, pre: list[str]) -> list[int]:
        if not self.separable:
            return [len(x) for x in self.model.encode(pre, num_threads=1)]
        # encode() puts a space mark before the text: it stands for the pre-token's own, or else goes with a line feed
        asked = [p[1:] if p[0] == SPACE else "\n" + p for p in pre]
        return [max(0, len(ids) - 2 * (p[0] != SPACE)) if a else 1 for p, a, ids in zip(pre, asked, self.model.encode(asked, num_threads=1), strict=True)]


def _packed(values: np.ndarray) -> bytes:
    """Numbers in the fewest of 1, 2 or 4 bytes each, after a byte that tells which."""
    width = 1 if not len(values) or values.max() < 256 else 2 if values.max() < 65536 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("i8")


_BLOCK = "block long, doc_ids array<bigint>, n_bytes array<bigint>, places array<binary>, times array<binary>, buckets array<int>, starts array<int>, words array<string>"


def _listed(known: dict[str, int], buckets: int, together: bool) -> tuple[np.ndarray, list[int], list[int], list[str]]:
    """The places of ``known``'s words in a block's list, and each part's bucket, first place and words, one a line. The
    word that is a line feed is an empty line; where others may hold one, words don't go ``together`` in a part."""
    import xxhash

    words = sorted(known)
    bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), "i4", len(words))
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(words), "i8")
    place[np.fromiter((known[words[i]] for i in order.tolist()), "i8", len(words))] = np.arange(len(words))
    first = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() if together else list(range(len(words)))
    ends = [*first, len(words)][1:]  # none for a block of empty texts
    parts = ["\n".join("" if words[k] == "\n" else words[k] for k in order[i:j].tolist()) for i, j in zip(first, ends, strict=True)]
    return place, bucket[order[first]].tolist(), first, parts


def _blocks(path: str, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        counter, part, number = PieceCounter.of(path), TaskContext.get().partitionId(), 0
        known, docs, chars = {}, [], 0

        def block() -> pd.DataFrame:
            place, *lists = _listed(known, buckets, counter.separable)
            rows = []
            for doc, n, own, often in docs:
                at = place[own]
                order = np.argsort(at)
                rows.append((doc, n, _packed(np.diff(at[order], prepend=0)), _packed(often[order])))
            return pd.DataFrame([[part << 32 | number, *zip(*rows, strict=True), *lists]], columns=["block", "doc_ids", "n_bytes", "places", "times", "buckets", "starts", "words"])

        for batch in batches:
            for doc, n, text in zip(batch["doc_id"].tolist(), batch["n_bytes"].tolist(), batch["text"], strict=True):
                if docs and chars + len(text) > BLOCK_CHARS:
                    yield block()
                    known, docs, chars, number = {}, [], 0, number + 1
                found = counter.frequencies(text)
                own = np.fromiter((known.setdefault(p, len(known)) for p in found), "i4", len(found))
                docs.append((None if pd.isna(doc) else int(doc), n, own, np.fromiter(found.values(), "i4", len(found))))
                chars += len(text)
        if docs:
            yield block()

    return run


def _counted(path: str):
    """Over (block, place, word) in the order of words: each block's places and their pieces, some words at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, last, held = PieceCounter.of(path), (None, 0), []

        def out():
            block, place, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort([place, block])
            block, place, n = block[order], place[order], n[order]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True))
            return pd.DataFrame({"block": block[first], "places": [_packed(np.diff(place[i:j], prepend=0)) for i, j in cuts], "pieces": [_packed(n[i:j]) for i, j in cuts]})

        for batch in batches:
            if not len(batch):
                continue
            words = np.array([w or "\n" for w in batch["word"]], dtype=object)
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            known = [last[1]] if words[0] == last[0] else []
            each = np.array(known + counter.pieces(words[first[len(known) :]].tolist()), "i8")
            last = (words[-1], int(each[-1]))
            held.append((batch["block"].to_numpy("i8"), batch["place"].to_numpy("i8"), np.repeat(each, np.diff(np.r_[first, len(words)]))))
            if sum(len(x) for x, _, _ in held) >= TOGETHER:
                yield out()
                held = []
        if held:
            yield out()

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for docs, sizes, freq_places, times, counts in zip(batch["doc_ids"], batch["n_bytes"], batch["places"], batch["times"], batch["counts"], strict=True):
            found = [(np.cumsum(_unpacked(c["places"])), _unpacked(c["pieces"])) for c in (counts if counts is not None else [])]
            each = np.zeros(sum(len(p) for p, _ in found), "i8")
            for p, n in found:
                each[p] = n
            total = [int((each[np.cumsum(_unpacked(p))] * _unpacked(t)).sum()) if len(p) > 1 else 0 for p, t in zip(freq_places, times, strict=True)]
            yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(d) else int(d) for d in docs], "Int64"), "n_bytes": sizes, "n_tokens": total})


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs`` (doc_id, text) under a sentencepiece model.

    Null and empty texts have no tokens. Rows that repeat a doc_id are counted each on its own; an empty table gives no
    rows. Texts hold as many tokens as the library gives for them whole.
    """
    with scratch(docs.sparkSession) as result:
        rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
        blocks = materialise(rows.mapInPandas(_blocks(model, BUCKETS * range_count(rows)), _BLOCK), compression="zstd")
        parts = blocks.select("block", F.explode(F.arrays_zip("buckets", "starts", "words")).alias("part")).select("block", "part.*").repartition("buckets")
        split = F.split("words", "\n") if PieceCounter.of(model).separable else F.array("words")
        words = parts.select("block", "buckets", "starts", F.posexplode(split).alias("pos", "word")).select("block", "buckets", (F.col("starts") + F.col("pos")).alias("place"), "word")
        counted = words.sortWithinPartitions("buckets", "word").mapInPandas(_counted(model), "block long, places binary, pieces binary")
        lists = counted.groupBy("block").agg(F.collect_list(F.struct("places", "pieces")).alias("counts"))
        summed = blocks.drop("buckets", "starts", "words").join(lists, "block", "left").mapInPandas(_summed, "doc_id long, n_bytes long, n_tokens long")
        return result(materialise(summed).withColumn("over_limit", F.col("n_tokens") > limit))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
