"""Alignments: residue maps, transfer, dedup, diversity, donors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from ..functions import frames
from ..functions.align import SCHEMA, align_udf, score_udf
from ..functions.store import materialise
from ..functions.transfer import moved_rows, ungapped_blocks


# A filter on the result of a deterministic function is pushed below it, so that the function runs for the filter and for the result. These
# run once.
_align, _score, _moved = (F.pandas_udf(f.func, kind).asNondeterministic() for f, kind in ((align_udf, SCHEMA), (score_udf, IntegerType()), (moved_rows, StringType())))


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs are few bytes and much work, so they are dealt out evenly."""
    return pairs.repartition(max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def align(pairs: DataFrame) -> DataFrame:
    """Adds the alignment's columns to pairs with q_seq and t_seq; pairs that don't align go."""
    kept = [c for c in pairs.columns if c != "score"]
    return _dealt(pairs).withColumn("aln", _align("q_seq", "t_seq")).filter("aln.score IS NOT NULL").select(*kept, "aln.*")


def scored(pairs: DataFrame) -> DataFrame:
    """Adds the score of each pair's best local alignment, without its path; pairs that don't align go. A first pass over all
    candidates: ``align`` is for those that are used."""
    return _dealt(pairs).withColumn("score", _score("q_seq", "t_seq")).filter("score > 0")


def residue_map(hsps: DataFrame) -> DataFrame:
    """(hsp_id, hit_idx, query_idx) of hsps (hsp_id, qseq, hseq, q_from, h_from), long form, from the ungapped blocks."""
    blocks = ungapped_blocks(F.col("qseq"), F.col("hseq"), F.col("q_from"), F.col("h_from"))
    each = hsps.select("hsp_id", F.explode(blocks).alias("b")).select("hsp_id", "b", F.explode(F.sequence(F.lit(0), F.col("b.n") - 1)).alias("k"))
    return each.select("hsp_id", (F.col("b.h") + F.col("k")).cast("long").alias("hit_idx"), (F.col("b.q") + F.col("k")).cast("long").alias("query_idx"))


def transfer_rows(rows: DataFrame) -> DataFrame:
    """Rows (…, seq, qseq, hseq, q_from, h_from, q_len, h_len) in query columns, as ``moved``; rows that hold nothing there go."""
    return rows.withColumn("moved", _moved("seq", "qseq", "hseq", "q_from", "h_from", "q_len", "h_len")).filter("moved IS NOT NULL")


#: Rows of a query that one task folds, at most; a query of more is decided in rounds.
FOLDED = 200_000


def greedy_dedup(rows: DataFrame, max_depth: int = 0, folded: int = FOLDED) -> DataFrame:
    """Verdicts (query_id, row_ord, verdict) of rows (query_id, query, row_ord, member, seq): an order-dependent fold. With
    ``max_depth``, rows after that many (with the query's own) are capped. The rows of a query of up to ``folded`` rows are folded by
    one task; those of larger ones are decided in rounds by many, to the same verdicts."""
    large = materialise(rows.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") > folded).select("query_id"))
    schema = "query_id long, row_ord int, verdict string"

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_ord")
        return pd.DataFrame({"query_id": g["query_id"], "row_ord": g["row_ord"], "verdict": frames.greedy_dedup(g["query"].iat[0], list(zip(g["member"], g["seq"], strict=True)), max_depth)})

    if not large.limit(1).count():
        return rows.groupBy("query_id").applyInPandas(fold, schema)
    small = rows.join(large, "query_id", "left_anti").groupBy("query_id").applyInPandas(fold, schema)
    of_large = dedup_in_rounds(rows.join(large, "query_id", "left_semi"), max_depth)
    return small.unionByName(of_large.select(F.col("query_id").cast("long").alias("query_id"), F.col("row_ord").cast("int").alias("row_ord"), "verdict"))


def dedup_in_rounds(rows: DataFrame, max_depth: int = 0) -> DataFrame:
    """The verdicts of ``greedy_dedup``, of queries of any size. A row that is the first undecided one of its member and of its sequence is
    kept, since nothing before it can reject it; a row that shares a member or sequence with one that is kept is rejected. At least the
    first undecided row is decided in every round. Members and sequences go as hashes of 128 bits, and firsts are combined before
    they are shuffled, so one that most rows share is no hot key."""

    def hashed(c: str):
        return F.md5(F.col(c).cast("binary"))

    every = materialise(rows.select("query_id", "row_ord", hashed("member").alias("m"), hashed("seq").alias("s"), (F.col("seq") == F.col("query")).alias("same")))

    def first(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.groupBy("query_id", key).agg(F.min("row_ord").alias(name))

    open_rows, kept = every.filter("NOT same").select("query_id", "row_ord", "m", "s"), None
    while True:
        now = materialise(open_rows.join(first(open_rows, "m", "first_m"), ["query_id", "m"]).filter("row_ord = first_m").join(first(open_rows, "s", "first_s"), ["query_id", "s"]).filter("row_ord = first_s").select("query_id", "row_ord", "m", "s"))
        if not now.limit(1).count():
            break
        kept = now if kept is None else kept.unionByName(now)
        open_rows = materialise(open_rows.join(now.select("query_id", "m"), ["query_id", "m"], "left_anti").join(now.select("query_id", "s"), ["query_id", "s"], "left_anti"))
    if kept is None:  # every row is its query's own sequence
        kept = every.filter("false").select("query_id", "row_ord", "m", "s")
    of_member = kept.select("query_id", "m", F.col("row_ord").alias("kept_m"))
    judged = every.join(of_member, ["query_id", "m"], "left").join(kept.select("query_id", "row_ord", F.lit(True).alias("stays")), ["query_id", "row_ord"], "left")
    verdict = F.when(F.col("stays"), "kept").when(F.col("kept_m") < F.col("row_ord"), "dup_id").otherwise("dup_seq")
    if max_depth:
        # the query's own row counts as one; what comes after the last row that fits is capped
        place = Window.partitionBy("query_id").orderBy("row_ord")
        last = kept.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= max_depth - 1).groupBy("query_id").agg(F.max("row_ord").alias("last"), F.count("*").alias("n")).filter(F.col("n") == max_depth - 1)
        judged = judged.join(last.select("query_id", "last"), "query_id", "left")
        verdict = F.when((F.col("row_ord") > F.col("last")) | F.lit(max_depth == 1), "capped").otherwise(verdict)
    return judged.select("query_id", "row_ord", verdict.alias("verdict"))


def merge_stats(verdicts: DataFrame, *by: str) -> DataFrame:
    """What dedup kept and dropped of each query, or of each ``by`` column's value of it."""
    return verdicts.groupBy("query_id", *by).agg(F.count_if(F.col("verdict") == "kept").alias("added"), F.count("*").alias("total"), F.count_if(F.col("verdict") == "dup_id").alias("dup_id"), F.count_if(F.col("verdict") == "dup_seq").alias("dup_seq"))


def diverse_hits(hits: DataFrame, max_pair_identity: float = 0.9, max_hits: int = 0) -> DataFrame:
    """(query_id, hit_ord, chosen, dup_of) of hits (query_id, hit_ord, acc, qseq, hseq, q_from, q_len). A task holds the hits of
    one query: the top ones of a search."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("hit_ord")
        seen = frames.diverse([frames.in_query_frame(*x) for x in zip(g["qseq"], g["hseq"], g["q_from"], g["q_len"], strict=True)], max_pair_identity, max_hits)
        accs = g["acc"].tolist()
        return pd.DataFrame({"query_id": g["query_id"], "hit_ord": g["hit_ord"], "chosen": [t == -1 for t in seen], "dup_of": [accs[t] if t is not None and t >= 0 else None for t in seen]})

    return hits.groupBy("query_id").applyInPandas(fold, "query_id long, hit_ord int, chosen boolean, dup_of string")


def pick_donor(hits: DataFrame, with_msa: DataFrame) -> DataFrame:
    """For each query the hit of most score that has an alignment of its own (with_msa: acc); ties by rank."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "rank")
    return hits.join(with_msa.select("acc").distinct(), "acc", "left_semi").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def pick_donors(hits: DataFrame, with_msa: DataFrame, most: int = 1, max_pair_identity: float = 0.9) -> DataFrame:
    """For each query up to ``most`` of its scored hits that have alignments of their own, aligned, as ``donor_ord`` from 0: the best by
    score, and after it those that are diverse from the ones before. A hit without an alignment hides no other.

    Paths are followed for hits that are looked at: the best one, or the best 2 * ``most``, and further ones of the queries only
    that found fewer than ``most`` diverse ones among these."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "rank")
    placed = hits.join(with_msa.select("acc").distinct(), "acc", "left_semi").withColumn("hit_ord", F.row_number().over(order))
    if most == 1:
        return align(placed.filter("hit_ord = 1")).withColumn("donor_ord", F.col("hit_ord") - 1).drop("hit_ord")
    placed = materialise(placed)

    def chosen_of(aligned: DataFrame) -> DataFrame:
        diverse = diverse_hits(aligned.select(F.col("query").alias("query_id"), "hit_ord", "acc", "qseq", "hseq", "q_from", F.length("q_seq").alias("q_len")), max_pair_identity, most)
        return aligned.join(diverse.filter("chosen").select(F.col("query_id").alias("query"), "hit_ord"), ["query", "hit_ord"])

    near = materialise(align(placed.filter(F.col("hit_ord") <= 2 * most)))
    found = materialise(chosen_of(near))
    enough = found.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("query")
    again = placed.filter(F.col("hit_ord") > 2 * most).join(enough, "query", "left_anti")
    open_ones = again.select("query").distinct()
    whole = near.join(open_ones, "query", "left_semi").unionByName(align(again))
    chosen = found.join(open_ones, "query", "left_anti").unionByName(chosen_of(whole))
    return chosen.withColumn("donor_ord", F.row_number().over(Window.partitionBy("query").orderBy("hit_ord")) - 1).drop("hit_ord")
