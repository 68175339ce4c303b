"""The minimizer index: postings, buckets, offsets, file plan, counters."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seeding import K, TARGET, seed_arrays, seed_rows
from ..functions.store import materialise
from ..sources.corpus import MAX_LEN, MIN_LEN

BUCKET_BITS = 25
#: Postings of a file, about, and bytes of one in the published layout, by which reads are counted.
PER_FILE = 20_000_000
POST_BYTES = 5


def postings(corpus: DataFrame, bits: int = BUCKET_BITS, **options) -> DataFrame:
    """(seed, bucket, residual, id, ord) rows of a corpus (id, seq); ``options`` are those of seeding (w: a fixed window)."""
    return seed_rows(corpus, **options).select("seed", F.shiftright("seed", 31 - bits).cast("int").alias("bucket"), F.col("seed").bitwiseAND(F.lit(255)).cast("int").alias("residual"), "id", "ord")


def build_counters(corpus: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each value of ``by``: n_seq, n_post, too_short, too_long, bad_chars of an unfiltered corpus (id, seq)."""
    n = F.length("seq")
    inside = n.between(MIN_LEN, MAX_LEN)
    rows = corpus.select(*by, "seq", seed_arrays("seq").alias("found")).select(*by, n.alias("n"), F.when(inside, F.size("found")).alias("k"))
    return rows.groupBy(*by).agg(F.count_if(F.col("k") > 0).alias("n_seq"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_post"), F.count_if(F.col("n") < MIN_LEN).alias("too_short"), F.count_if(F.col("n") > MAX_LEN).alias("too_long"), F.count_if(F.col("k") == 0).alias("bad_chars"))


def write_shard_counters(corpus: DataFrame, path: str) -> None:
    """What each shard of an unfiltered corpus (shard, id, seq) holds and lost, as JSON records beside the shards. A write that is
    repeated replaces them."""
    per_seq = F.coalesce(F.try_divide("n_post", "n_seq"), F.lit(0.0))
    named = [F.col(c).alias(name) for c, name in (("n_seq", "nSeq"), ("n_post", "nPost"), ("too_short", "tooShort"), ("too_long", "tooLong"), ("bad_chars", "badChars"))]
    build_counters(corpus, "shard").select("shard", *named, F.lit(K).alias("k"), F.lit(TARGET).alias("targetSeeds"), per_seq.alias("seedsPerSeq")).write.mode("overwrite").json(path)


def read_shard_counters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard string, nSeq long, nPost long, tooShort long, tooLong long, badChars long, k int, targetSeeds int, seedsPerSeq double").json(path)


def bucket_histogram(posted: DataFrame) -> DataFrame:
    return posted.groupBy("bucket").agg(F.count("*").alias("n_postings"))


def bucket_offsets(posted: DataFrame, coarse_bits: int = 10) -> DataFrame:
    """(bucket, off_lo, off_hi): prefix sums in two levels, over groups of 2^coarse_bits buckets and inside each."""
    counts = bucket_histogram(posted).withColumn("grp", F.shiftright("bucket", coarse_bits))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.groupBy("grp").agg(F.sum("n_postings").alias("n")).select("grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    upto = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = counts.withColumn("upto", F.sum("n_postings").over(upto)).join(bases, "grp")
    return inside.select("bucket", (F.col("base") + F.col("upto") - F.col("n_postings")).alias("off_lo"), (F.col("base") + F.col("upto")).alias("off_hi"))


def posting_plan(posted: DataFrame, per_file: int) -> DataFrame:
    """Files cut on bucket boundaries: file_no, from_bucket, to_bucket (exclusive), post_from, post_to."""
    placed = bucket_offsets(posted).withColumn("file_no", F.floor(F.col("off_lo") / per_file))
    return placed.groupBy("file_no").agg(F.min("bucket").alias("from_bucket"), (F.max("bucket") + 1).alias("to_bucket"), F.min("off_lo").alias("post_from"), F.max("off_hi").alias("post_to"))


def write_index(corpus: DataFrame, path: str, per_file: int = PER_FILE, bits: int = BUCKET_BITS) -> None:
    """Write the index of ``corpus`` (id, seq, and acc for accessions): postings and bucket offsets in files that are cut on
    bucket boundaries after about ``per_file`` postings and ordered by bucket, the entries, and the metadata with the
    files' bucket ranges."""
    posted = materialise(postings(corpus, bits))
    offsets = materialise(bucket_offsets(posted).withColumn("file_no", F.floor(F.col("off_lo") / per_file).cast("long")))
    placed = posted.join(offsets.select("bucket", "file_no"), "bucket")
    files = posting_plan(posted, per_file)
    for name, rows, order in (("postings", placed, ("bucket", "seed", "id")), ("offsets", offsets, ("bucket",))):
        rows.repartitionByRange(*order).sortWithinPartitions("file_no", *order).write.partitionBy("file_no").parquet(f"{path}/{name}")
    corpus.write.parquet(f"{path}/entries")
    counts = posted.agg(F.count("*").alias("nPost"), F.count_distinct("id").alias("nSeq"))
    listed = files.agg(F.array_sort(F.collect_list(F.struct(F.col("from_bucket").alias("fromBucket"), F.col("to_bucket").alias("toBucket"), F.col("post_from").alias("postFrom"), F.col("post_to").alias("postTo"), F.col("file_no").alias("fileNo")))).alias("files"))
    fixed = [F.lit(v).alias(k) for k, v in (("k", K), ("targetSeeds", TARGET), ("bucketBits", bits), ("shift", 31 - bits), ("postBytes", POST_BYTES))]
    counts.join(F.broadcast(listed)).select("nSeq", "nPost", *fixed, "files").write.json(f"{path}/meta")  # one row each


def assert_index_compatible(meta: DataFrame) -> None:
    found = meta.select("k", "targetSeeds").first()
    if (found["k"], found["targetSeeds"]) != (K, TARGET):
        raise ValueError(f"index and seeding differ: {found.asDict()}")


class Index:
    """A written index. What a search reads of it goes by the buckets of its seeds, not by the index's size."""

    #: Buckets of a search, at most, that are pushed down one by one; more are joined.
    pushed = 64
    #: Buckets of a cell, by which buckets meet the files whose ranges hold them.
    cell_bits = 10

    def __init__(self, spark: SparkSession, path: str) -> None:
        meta = spark.read.json(f"{path}/meta")
        assert_index_compatible(meta)
        self.meta = meta.first().asDict(recursive=True)
        self._files = meta.select(F.explode("files").alias("f")).select("f.*")
        self.entries = spark.read.parquet(f"{path}/entries")
        self._postings, self._offsets = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "offsets"))

    def seeds(self, chains: DataFrame) -> DataFrame:
        return postings(chains, self.meta["bucketBits"])

    def file_for(self, bucket: int) -> int | None:
        """The number of the file whose range holds a bucket."""
        ends = [f["toBucket"] for f in self.meta["files"]]
        at = bisect_right(ends, bucket)
        return self.meta["files"][at]["fileNo"] if at < len(ends) and bucket >= self.meta["files"][at]["fromBucket"] else None

    def files_of(self, buckets: DataFrame) -> DataFrame:
        """(bucket, file_no) of ``buckets`` (bucket): a range join, by equal cells. A file is in each cell that its range touches: 2^15 in
        all and one more for each file, so that side may be broadcast."""
        low, high = (F.shiftright(x, self.cell_bits) for x in (F.col("fromBucket"), F.col("toBucket") - 1))
        cells = self._files.select("fromBucket", "toBucket", F.col("fileNo").alias("file_no"), F.explode(F.sequence(low, high)).alias("cell"))
        placed = buckets.select("bucket", F.shiftright("bucket", self.cell_bits).cast("long").alias("cell"))
        return placed.join(cells, "cell").filter((F.col("bucket") >= F.col("fromBucket")) & (F.col("bucket") < F.col("toBucket"))).select("bucket", "file_no")

    def near(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings (bucket, residual, seed, id) and offsets of the buckets of ``wanted`` (bucket), however many they are. Only the
        files whose ranges hold one of them are read: their numbers, of which there are no more than files, are in the scan's
        partition filter."""
        buckets = wanted.select("bucket").distinct()
        placed = materialise(self.files_of(buckets))
        files = sorted(r["file_no"] for r in placed.select("file_no").distinct().collect())
        few = sorted(r["bucket"] for r in placed.select("bucket").limit(self.pushed + 1).collect())
        tables = [t.filter(F.col("file_no").isin(files)) for t in (self._postings, self._offsets)]
        if len(few) <= self.pushed:
            each = reduce(Column.__or__, [F.col("bucket") == b for b in few], F.lit(False))
            return tuple(t.filter(each) for t in tables)
        return tuple(t.join(placed.select("bucket"), "bucket", "left_semi") for t in tables)
