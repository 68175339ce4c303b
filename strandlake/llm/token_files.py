"""Token ids in seekable zstandard files.

A file holds one independent zstandard frame for each document (the ids as little-endian unsigned integers of 2 or 4
bytes), then a skippable frame with each document's doc_id and id width, then the seek table of the public zstandard
seekable format: each frame's compressed and decompressed size and the low 32 bits of the XXH64 of its content. A
reader opens the end of the file and then decompresses only the frames asked for, checking each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, range_count, read_table, remove, scratch, shared_dir, texts

# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

_ENTRY = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")


class Writer:
    def __init__(self, sink) -> None:
        import zstandard

        self.sink, self.frames, self.docs = sink, bytearray(), bytearray()
        self.count = 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        width = 2 if not len(ids) or ids.max() < 65536 else 4
        raw = ids.astype(f"<u{width}").tobytes()
        frame = self.zstd.compress(raw)
        self.sink.write(frame)
        self.frames += _ENTRY.pack(len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.docs += struct.pack("<?qB", doc_id is not None, doc_id or 0, width)
        self.count += 1

    def close(self) -> None:
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(self.docs)) + self.docs)
        # the seek table names the index as its last frame, without content
        table = bytes(self.frames) + _ENTRY.pack(len(self.docs) + 8, 0, _empty_sum())
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + _FOOTER.size) + table + _FOOTER.pack(self.count + 1, CHECKSUMS, SEEK_MAGIC))


def _empty_sum() -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF


class Reader:
    """Documents of one file by position; ``source`` is seekable."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.seek(0, 2)
        source.seek(size - _FOOTER.size)
        frames, flags, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table")
        length = frames * _ENTRY.size
        source.seek(size - _FOOTER.size - length - 8)
        if struct.unpack("<II", source.read(8)) != (SKIPPABLE_SEEK, length + _FOOTER.size):
            raise ValueError("broken seek table")
        table = np.frombuffer(source.read(length), "<u4").reshape(frames, 3).astype("i8")
        self.packed, self.unpacked, self.sums = table[:-1].T
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        source.seek(int(self.at[-1]) + 8)
        index = np.frombuffer(source.read(int(table[-1, 0]) - 8), np.dtype([("known", "?"), ("doc", "<i8"), ("width", "u1")]))
        self.doc_ids = [int(d) if k else None for k, d in zip(index["known"], index["doc"], strict=True)]
        self.widths = index["width"]
        self.n_tokens = self.unpacked // np.maximum(self.widths, 1)

    def ids(self, i: int) -> np.ndarray:
        import xxhash
        import zstandard

        self.source.seek(int(self.at[i]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.packed[i])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i}: wrong checksum")
        return np.frombuffer(raw, f"<u{self.widths[i]}").astype("<u4")

    def select(self, doc_ids: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents asked for; no other frame is read."""
        wanted = set(doc_ids)
        for i, d in enumerate(self.doc_ids):
            if d in wanted:
                yield d, self.ids(i)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _writing(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from .bpe import Encoder, small_batches

        encoder, task = Encoder.of(tokenizer), TaskContext.get()
        end = np.array([end_id], "<u4").tobytes()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.zst"  # a lost task's file is never in the manifest
        store, path = _filesystem(folder)
        writer = out = None
        tokens = 0
        for batch in batches:
            for cut in small_batches(batch["text"].str.len().tolist()):
                rows = batch.iloc[cut]
                if writer is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    writer = Writer(out)
                for doc, ids in zip(rows["doc_id"].tolist(), encoder.encode(rows["text"].tolist()), strict=True):
                    own = np.frombuffer(ids + end, "<u4")
                    writer.add(None if pd.isna(doc) else int(doc), own)
                    tokens += len(own)
        if writer is not None:
            writer.close()
            out.close()
            yield pd.DataFrame({"part": [task.partitionId()], "file": [f"{folder}/{name}"], "n_docs": [writer.count], "n_tokens": [tokens]})

    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order, a file for each range of doc_id. Returns the manifest:
    part (the files' order), file, n_docs, n_tokens, base (ids in the files before). ``folder`` is a URI that the driver
    and all executors reach (local, HDFS, S3: what Arrow's file systems open)."""
    ordered = texts(docs)
    rows = ordered.repartitionByRange(range_count(ordered), "doc_id").sortWithinPartitions("doc_id", "text")
    written = materialise(rows.mapInPandas(_writing(folder, tokenizer, end_id), "part int, file string, n_docs long, n_tokens long"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return written.withColumn("base", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)))


def _reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, base in zip(batch["file"], batch["base"], strict=True):
            store, path = _filesystem(file)
            with store.open_input_file(path) as source:
                reader = Reader(source)
                starts = base + np.concatenate([[0], np.cumsum(reader.n_tokens)])
                for i in range(0, len(reader.doc_ids), 2000):
                    docs = reader.doc_ids[i : i + 2000]
                    crc = [zlib.crc32(reader.ids(i + k)) for k in range(len(docs))]
                    yield pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "start": starts[i : i + len(docs)], "n_tokens": reader.n_tokens[i : i + len(docs)], "ids_crc32": crc})


def read_token_files(manifest: DataFrame, parts: int) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, ids_crc32."""
    return manifest.select("file", "base").repartition(parts).mapInPandas(_reading, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` (doc_id, text) to token files in the shared folder and read them back.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are documents of their own, in the order of
    their texts; null doc_ids come first. An empty table writes no file and gives no rows.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}-tokens"
    with scratch(spark) as result:
        try:
            manifest = write_token_files(docs, tokenizer, folder, end_id)
            rows = read_token_files(manifest, range_count(texts(docs)))
            # four numbers a document: files of about a million
            return result(materialise(rows.repartition(1 + (manifest.agg(F.sum("n_docs")).first()[0] or 0) // 1_000_000)))
        finally:
            remove(spark, folder)  # all of it has been read, or nothing will be


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
