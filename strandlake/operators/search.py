"""Index search: shared seeds, hot buckets, top candidates, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import materialise
from ..sources.corpus import MIN_LEN
from .index import POST_BYTES, Index, postings

TOP_K = 20
MAX_POSTINGS = 20_000
SEED_CAP = 2000
#: Hits that a task counts, about, and tasks that count, at most.
TASK_HITS = 1_000_000
MOST_TASKS = 20_000


def _sides(query_seeds: DataFrame, posted: DataFrame, cap: int, offsets: DataFrame | None) -> tuple[DataFrame, DataFrame, list[str]]:
    near = posted.select("bucket", "residual", "id").join(query_seeds.select("bucket").distinct(), "bucket", "left_semi")
    sizes = near.groupBy("bucket").agg(F.count("*").alias("bucket_size")) if offsets is None else offsets.select("bucket", (F.col("off_hi") - F.col("off_lo")).alias("bucket_size"))
    wanted = query_seeds.select(F.col("id").alias("query"), "ord", "bucket", "residual").join(sizes.filter(F.col("bucket_size") <= cap), "bucket", "left_semi")
    return wanted, near, ["bucket", "residual"]


def _sides_by_seed(query_seeds: DataFrame, posted: DataFrame, cap: int) -> tuple[DataFrame, DataFrame, list[str]]:
    near = posted.select("seed", "id").join(query_seeds.select("seed").distinct(), "seed", "left_semi")
    sizes = near.groupBy("seed").agg(F.count("*").alias("c")).filter(F.col("c") <= cap).select("seed")
    return query_seeds.select(F.col("id").alias("query"), "ord", "seed").join(sizes, "seed", "left_semi"), near, ["seed"]


def hits(query_seeds: DataFrame, posted: DataFrame, cap: int = MAX_POSTINGS, offsets: DataFrame | None = None) -> DataFrame:
    """(query, ord, id) of every posting of a query's seed whose bucket holds at most ``cap`` postings. Only the queries'
    buckets are looked at; their sizes come from ``offsets``, or are counted. The cap drops hot keys before the join, so
    no seed is a skewed key."""
    wanted, near, keys = _sides(query_seeds, posted, cap, offsets)
    return wanted.join(near, keys).select("query", "ord", "id")


def search_index(index: Index, chains: DataFrame, k: int = TOP_K, cap: int = MAX_POSTINGS) -> DataFrame:
    """(query, rank, id, acc, shared): the top entries of a written index for chains (id, seq)."""
    wanted = materialise(index.seeds(chains))
    posted, offsets = index.near(wanted)
    return with_accessions(top_candidates(counted(wanted, posted, cap, offsets), k), index.entries)


def hits_by_seed(query_seeds: DataFrame, posted: DataFrame, cap: int = SEED_CAP) -> DataFrame:
    """As ``hits``, on whole seeds: those with more than ``cap`` postings are passed over."""
    wanted, near, keys = _sides_by_seed(query_seeds, posted, cap)
    return wanted.join(near, keys).select("query", "ord", "id")


def shared_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("query", "id").agg(F.count("*").alias("shared"), F.min("ord").alias("first_ord"))


def counted(query_seeds: DataFrame, posted: DataFrame, cap: int = 0, offsets: DataFrame | None = None, by_seed: bool = False, others: bool = False, parts: bool = False) -> DataFrame:
    """``shared_counts`` of ``hits``, or of ``hits_by_seed``; with ``others``, without the queries themselves. Seeds and postings are read more
    than once, so they should be stored.

    Hits grow faster than the postings that they come from, by which Spark would size tasks. So they are numbered first, and beyond
    TASK_HITS dealt by query, and by parts of the entries where one query has more than a task's, to so many tasks that none counts more than
    about TASK_HITS. With ``parts``, rows say their ``part`` of the entries."""
    wanted, near, keys = _sides_by_seed(query_seeds, posted, cap or SEED_CAP) if by_seed else _sides(query_seeds, posted, cap or MAX_POSTINGS, offsets)
    of_query = wanted.join(near.groupBy(*keys).agg(F.count("*").alias("n")), keys).groupBy("query").agg(F.sum("n").alias("n"))
    load = of_query.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    split = -(-load["most"] // TASK_HITS) or 1
    tasks = min(MOST_TASKS, -(-load["all"] // TASK_HITS))
    if tasks > 1:
        near = near.repartition(tasks, *keys)
    found = wanted.join(near, keys).select("query", "ord", "id", F.pmod(F.xxhash64("id"), F.lit(split)).cast("int").alias("part"))
    found = found.filter("query <> id") if others else found
    if tasks > 1:
        found = found.repartition(tasks, "query", "part")
    each = found.groupBy("query", "part", "id").agg(F.count("*").alias("shared"), F.min("ord").alias("first_ord"))
    return each if parts else each.drop("part")


def leading(counts: DataFrame, k: int) -> DataFrame:
    """Of counts with parts the k best of each part of each query, beside how many ``candidates`` the part has, at the part's first (``place`` 1)."""
    own = Window.partitionBy("query", "part")
    placed = counts.withColumn("place", F.row_number().over(own.orderBy(F.col("shared").desc(), "first_ord", "id"))).withColumn("candidates", F.count("*").over(own))
    return placed.filter(F.col("place") <= max(1, k))


def candidates_of(leaders: DataFrame) -> DataFrame:
    """(query, candidates) of the rows of ``leading``."""
    return leaders.filter("place = 1").groupBy("query").agg(F.sum("candidates").alias("candidates"))


def top_candidates(counts: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k ids of most shared seeds of each query; ties by the first seed that hit, then id."""
    order = Window.partitionBy("query").orderBy(F.col("shared").desc(), "first_ord", "id")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "id", "shared")


def with_accessions(top: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates whose accession resolves; those that don't go after the cut at k, not before."""
    return top.join(entries.select("id", "acc").filter("acc IS NOT NULL"), "id").select("query", "rank", "id", "acc", "shared")


def lookup_stats(query_seeds: DataFrame, posted: DataFrame, cap: int = MAX_POSTINGS) -> DataFrame:
    """For each query with seeds: n_seeds, seeds_found, seeds_skipped, bytes_read (two offsets of four bytes for each seed, and
    the postings of buckets that aren't skipped), candidates."""
    near = posted.select("bucket", "residual", "id").join(query_seeds.select("bucket").distinct(), "bucket", "left_semi")
    sizes = near.groupBy("bucket").agg(F.count("*").alias("bucket_size"))
    present = near.select("bucket", "residual").distinct().withColumn("present", F.lit(True))
    per_seed = query_seeds.select(F.col("id").alias("query"), "bucket", "residual").join(sizes, "bucket", "left").join(present, ["bucket", "residual"], "left")
    hot = F.coalesce(F.col("bucket_size") > cap, F.lit(False))
    read = F.lit(8) + F.when(hot, 0).otherwise(POST_BYTES * F.coalesce("bucket_size", F.lit(0)))
    stats = per_seed.groupBy("query").agg(F.count("*").alias("n_seeds"), F.count_if(~hot & F.col("present")).alias("seeds_found"), F.count_if(hot).alias("seeds_skipped"), F.sum(read).alias("bytes_read"))
    candidates = counted(query_seeds, posted, cap).groupBy("query").agg(F.count("*").alias("candidates"))
    return stats.join(candidates, "query", "left").fillna(0, ["candidates"])


@dataclass
class StoredIndex:
    """An index in parts: postings (seed, bucket, residual, id, ord, part), where a part is a bucket's upper ``part_bits`` and a partition
    of the stored files, the buckets' sizes (bucket, n_postings), and entries (id, acc)."""

    postings: DataFrame
    sizes: DataFrame
    entries: DataFrame
    bucket_bits: int
    part_bits: int

    def search(self, chains: DataFrame, least: int = MIN_LEN, k: int = TOP_K, cap: int = MAX_POSTINGS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
        """(candidates, lookups, cached) of chains (id, seq): the top entries (query, rank, id, acc, shared), and for each chain, also
        without any, (query, n_residues, n_seeds, seeds_skipped, candidates). The seeds, and the leading candidates with their number, are
        cached for both; the caller releases them. Only parts that hold buckets of the seeds are read, and the sizes of buckets are
        stored, not counted."""
        seeds = postings(chains.filter(F.length("seq") >= least), self.bucket_bits).withColumn("part", F.shiftright("bucket", self.bucket_bits - self.part_bits)).persist()
        parts = [r["part"] for r in seeds.select("part").distinct().collect()]  # at most 2^part_bits
        known = self.sizes.join(seeds.select("bucket").distinct(), "bucket", "left_semi")
        offsets = known.select("bucket", F.lit(0).alias("off_lo"), F.col("n_postings").alias("off_hi"))
        leaders = leading(counted(seeds, self.postings.filter(F.col("part").isin(parts)), cap, offsets, parts=True), k).persist()
        hot = known.filter(F.col("n_postings") > cap).select("bucket").withColumn("hot", F.lit(True))
        of_seeds = seeds.join(hot, "bucket", "left").groupBy(F.col("id").alias("query")).agg(F.count("*").alias("n_seeds"), F.count_if("hot").alias("seeds_skipped"))
        each = chains.select(F.col("id").alias("query"), F.length("seq").alias("n_residues")).join(of_seeds, "query", "left").join(candidates_of(leaders), "query", "left")
        return with_accessions(top_candidates(leaders, k), self.entries), each.fillna(0, ["n_seeds", "seeds_skipped", "candidates"]), [seeds, leaders]
