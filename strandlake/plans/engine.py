"""End to end: chains to query-framed alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import donor_label, match_states, member_id_of
from ..functions.store import materialise
from ..operators import index, msa, search
from ..sources.alignments import fetch_cached
from ..sources.corpus import parse_a3m


def merged_rows(chains: DataFrame, donors: DataFrame, msas: DataFrame, max_depth: int = 0) -> DataFrame:
    """(query, q_seq, donor_ord, acc, row_ord, name, moved, verdict): the rows of each donor's alignment (msas: acc, text) in
    the columns of its query, in the order of donors and rows, and what dedup made of them."""
    parsed = parse_a3m(msas.join(donors.select("acc").distinct(), "acc", "left_semi").select(F.col("acc").alias("msa_id"), "text"))
    first = parsed.filter("row_ord = 0").select(F.col("msa_id").alias("acc"), match_states(F.col("seq")).alias("columns"))
    keyed = parsed.withColumnRenamed("msa_id", "acc").join(first, "acc").join(donors, "acc")
    label = F.when(F.col("row_ord") == 0, donor_label(F.col("acc"), F.col("descr"), F.col("organism"), F.col("taxid"))).otherwise(F.col("name"))
    hit_length = F.coalesce(F.nullif(F.length("t_seq"), F.lit(0)), F.col("columns"))
    moved = msa.transfer_rows(keyed.select("query", "donor_ord", "acc", "row_ord", label.alias("name"), "seq", "qseq", "hseq", "q_from", "h_from", F.length("q_seq").alias("q_len"), hit_length.alias("h_len"), "q_seq"))
    ordered = moved.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("donor_ord", "row_ord")))
    judged = msa.greedy_dedup(ordered.select(F.col("query").alias("query_id"), F.upper("q_seq").alias("query"), F.col("place").alias("row_ord"), member_id_of(F.col("name")).alias("member"), F.col("moved").alias("seq")), max_depth)
    return ordered.join(judged.select(F.col("query_id").alias("query"), F.col("row_ord").alias("place"), "verdict"), ["query", "place"])


def candidate_pairs(chains: DataFrame, corpus: DataFrame, top_k: int = search.TOP_K, exclude_self: bool = False) -> DataFrame:
    """The top candidates of chains (id, seq) in corpus (id, acc, seq, descr, organism, taxid), with both sequences."""
    posted, wanted = (materialise(index.postings(x)) for x in (corpus, chains))
    top = search.top_candidates(search.counted(wanted, posted, others=exclude_self), top_k)
    named = search.with_accessions(top, corpus)
    return named.join(chains.select(F.col("id").alias("query"), F.col("seq").alias("q_seq")), "query").join(corpus.select("id", F.col("seq").alias("t_seq"), "descr", "organism", "taxid"), "id")


def aligned_hits(chains: DataFrame, corpus: DataFrame, top_k: int = search.TOP_K, exclude_self: bool = False) -> DataFrame:
    """``candidate_pairs``, aligned."""
    return msa.align(candidate_pairs(chains, corpus, top_k, exclude_self))


def _donors(chains: DataFrame, corpus: DataFrame, msas: DataFrame, top_k: int, donors: int, exclude_self: bool, max_pair_identity: float) -> DataFrame:
    """The donors of each chain. Stored: what follows reads them more than once, and they are the dear part. Candidates without an
    alignment are not scored."""
    pairs = candidate_pairs(chains, corpus, top_k, exclude_self).join(msas.select("acc").distinct(), "acc", "left_semi")
    return materialise(msa.pick_donors(msa.scored(pairs), msas, donors, max_pair_identity))


def build_msa(chains: DataFrame, corpus: DataFrame, msas: DataFrame, top_k: int = search.TOP_K, donors: int = 1, max_depth: int = 0, exclude_self: bool = False, max_pair_identity: float = 0.9, store: str | None = None) -> DataFrame:
    """(query, donor, row_ord, name, seq, n_match): each chain's (id, seq) alignment, borrowed from the best-scoring
    candidate of ``corpus`` that ``msas`` (acc, text) has one of, and further diverse ones up to ``donors``. The chain is row 0; rows that repeat a
    member or a sequence go; with ``max_depth``, so do rows after that many. Alignments are read for donors only. With
    ``exclude_self``, an entry with the chain's own id is no candidate. With ``store``, the donors' alignments are read through
    the store of that path, so that the next build takes them from there."""
    chosen = _donors(chains, corpus, msas, top_k, donors, exclude_self, max_pair_identity)
    msas = fetch_cached(msas, chosen, store) if store else msas
    rows = merged_rows(chains, chosen, msas, max_depth).filter("verdict = 'kept'")
    own = chains.join(chosen.select(F.col("query").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query"), F.lit(None).cast("string").alias("donor"), F.lit(0).alias("row_ord"), F.concat(F.lit("chain_"), "id").alias("name"), F.upper("seq").alias("seq"))
    out = own.unionByName(rows.select("query", F.col("acc").alias("donor"), F.col("place").alias("row_ord"), "name", F.col("moved").alias("seq")))
    return out.withColumn("n_match", match_states(F.col("seq")))


def donor_stats(chains: DataFrame, corpus: DataFrame, msas: DataFrame, top_k: int = search.TOP_K, donors: int = 1, max_depth: int = 0, exclude_self: bool = False, max_pair_identity: float = 0.9) -> DataFrame:
    """(query_id, donor_ord, acc, added, total, dup_id, dup_seq): what each donor's alignment was worth."""
    chosen = _donors(chains, corpus, msas, top_k, donors, exclude_self, max_pair_identity)
    rows = merged_rows(chains, chosen, msas, max_depth)
    return msa.merge_stats(rows.withColumnRenamed("query", "query_id"), "donor_ord", "acc")
