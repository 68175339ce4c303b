"""Beyond batch: a stream of chains against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import bucket_histogram, postings
from ..operators.search import MAX_POSTINGS


def stream_hits(chains: DataFrame, posted: DataFrame, cap: int = MAX_POSTINGS) -> DataFrame:
    """(query, ord, id) for each seed that a streamed chain (id, seq) shares with static postings: a stateless join. Buckets of more than
    ``cap`` postings are passed over, as in batch searches; they are dropped from the static side, so no bucket is a skewed key. A sink
    that counts and ranks gets what ``search.shared_counts`` and ``search.top_candidates`` make of it."""
    cold = posted.join(bucket_histogram(posted).filter(F.col("n_postings") <= cap).select("bucket"), "bucket", "left_semi")
    wanted = postings(chains).select(F.col("id").alias("query"), "ord", "bucket", "residual")
    return wanted.join(cold.select("bucket", "residual", "id"), ["bucket", "residual"]).select("query", "ord", "id")
