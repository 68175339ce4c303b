"""Payloads, paired alignments in pieces, shard counters, the published caps, and tables that go with the application."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from strandlake.operators import index, search
from strandlake.sources import corpus as src
from strandlake.sources import payloads

from test_functions import HBA, HBB

ROOT = Path(__file__).resolve().parent.parent


def test_payloads(spark):
    bodies = [
        ("object", '{"uniprotSequence": "ACD", "uniprotDescription": "d", "organismScientificName": "o", "taxId": 9606, "more": [1]}'),
        ("array", '[{"uniprotSequence": "KLM", "taxId": "7"}, {"uniprotSequence": "other"}]'),
        ("zero", '{"uniprotSequence": "A", "uniprotDescription": null, "taxId": 0}'),
        ("none", '{"uniprotDescription": "d"}'), ("blank", '{"uniprotSequence": ""}'), ("empty", "[]"), ("hollow", '[null, {"uniprotSequence": "A"}]'), ("broken", '{"uniprotSequence": "A'), ("text", ""), ("null", None),
    ]
    got = payloads.parse_payloads(spark.createDataFrame(bodies, "acc string, body string")).collect()
    assert [tuple(r) for r in got] == [("object", "ACD", "d", "o", "9606"), ("array", "KLM", "", "", "7"), ("zero", "A", "", "", "")]
    assert payloads.parse_payloads(spark.createDataFrame([], "acc string, body string")).count() == 0


def test_paired_alignments_in_pieces(spark, tmp_path):
    """A query with most of the rows lies in several files, which in the order of their names are its text."""
    heads = spark.createDataFrame([("big", "#3,3\t1,1"), ("small", "#2,2\t1,1")], "query_id string, header string")
    own = spark.createDataFrame([("big", 1, "KLM"), ("big", 0, "HIA"), ("small", 0, "AA"), ("small", 1, "CC")], "query_id string, chain int, seq string")
    paired = spark.range(3000).select(F.lit("big").alias("query_id"), (3000 - F.col("id")).cast("int").alias("paired_ord"), F.concat(F.lit("p"), "id").alias("name"), F.lit("ACDEFG").alias("seq"))
    rest = spark.range(2000).select(F.lit("big").alias("query_id"), (F.col("id") % 2).cast("int").alias("chain"), F.col("id").cast("int").alias("row_ord"), F.concat(F.lit("u"), "id").alias("name"), F.lit("ACD---").alias("seq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):  # a repeated write replaces the first
            src.write_paired_a3m(heads, own, paired, rest, str(tmp_path / "out"), wrap=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {r.msa_id: r.text for r in src.format_paired_a3m(heads, own, paired, rest, wrap=4).collect()}
    files = {q: sorted((tmp_path / "out" / f"msa_id={q}").glob("part-*")) for q in want}
    assert {q: "".join(f.read_text() for f in fs) for q, fs in files.items()} == want and len(files["big"]) > 2
    assert src.read_paired_a3m(spark, str(tmp_path / "out")).count() == sum(t.count("\n") for t in want.values())


def test_paired_text_of_pieces(spark, monkeypatch):
    """The text is joined from pieces of a few rows, collected by as many tasks as their bytes ask for; empty, wrapped and wide rows alike."""
    heads = spark.createDataFrame([("a", "#3,3\t1,1"), ("b", "#1,1\t1,1")], "query_id string, header string")
    own = spark.createDataFrame([("a", 1, "KLM"), ("a", 0, "HIA"), ("b", 0, "A"), ("b", 1, "C")], "query_id string, chain int, seq string")
    paired = spark.createDataFrame([("a", k, f"p{k}", "ACDEFG"[: k % 7]) for k in range(25, 0, -1)], "query_id string, paired_ord int, name string, seq string")
    rest = spark.createDataFrame([("a", k % 2, k, f"u{k}", "ACD---") for k in range(31, 0, -1)], "query_id string, chain int, row_ord int, name string, seq string")
    body = [("101", "HIAKLM")] + [(f"p{k}", "ACDEFG"[: k % 7]) for k in range(1, 26)] + [(f"u{k}", "ACD---") for c in (0, 1) for k in range(1, 32) if k % 2 == c]
    monkeypatch.setattr(src, "TASK_BYTES", 100)
    for piece_rows in (1, 4, 512):
        got = src.format_paired_a3m(heads, own, paired, rest, piece_rows=piece_rows)
        assert {r.msa_id: r.text for r in got.collect()} == {"a": "#3,3\t1,1\n" + "".join(f">{n}\n{q}\n" for n, q in body), "b": "#1,1\t1,1\n>101\nAC\n"}
        assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")  # no step after copies the text


def test_shard_counters(spark, tmp_path):
    rows = [("a", 0, HBA), ("a", 1, HBB), ("a", 2, "A" * 39), ("b", 3, "X" * 50), ("b", 4, "A" * 2001), ("b", 5, None)]
    corpus = spark.createDataFrame(rows, "shard string, id long, seq string")
    for _ in range(2):
        index.write_shard_counters(corpus, str(tmp_path / "c"))
    got = {r.shard: r for r in index.read_shard_counters(spark, str(tmp_path / "c")).collect()}
    assert (got["a"].nSeq, got["a"].nPost, got["a"].tooShort, got["a"].seedsPerSeq, got["a"].k, got["a"].targetSeeds) == (2, 24, 1, 12.0, 10, 12)
    assert (got["b"].nSeq, got["b"].nPost, got["b"].tooShort, got["b"].tooLong, got["b"].badChars, got["b"].seedsPerSeq) == (0, 0, 0, 1, 1, 0.0)


def test_published_caps(spark):
    """One text 20,001 times over: its buckets and seeds are passed over, and a query of both texts finds the other one's only."""
    one, many = spark.createDataFrame([(0, HBB)], "id long, seq string"), spark.range(1, 20_002).select("id", F.lit(HBA).alias("seq"))
    posted = index.postings(one.unionByName(many)).persist()
    wanted = index.postings(spark.createDataFrame([(7, HBA + HBB), (8, HBA)], "id long, seq string"))
    mine = {q: {(r.bucket, r.residual) for r in wanted.filter(F.col("id") == q).collect()} for q in (7, 8)}
    of = {name: {(r.bucket, r.residual) for r in posted.filter(F.col("id") == k).collect()} for name, k in (("many", 1), ("one", 0))}
    hot = {b for b, _ in of["many"]}
    got = {r["query"]: r for r in search.lookup_stats(wanted, posted).collect()}
    for q, seeds in mine.items():
        skipped, found = [s for s in seeds if s[0] in hot], [s for s in seeds if s[0] not in hot and s in of["one"]]
        assert (got[q].seeds_skipped, got[q].seeds_found, got[q].bytes_read) == (len(skipped), len(found), 8 * len(seeds) + 5 * len(found))
    assert got[7].seeds_skipped > 0 and got[7].candidates == 1 and got[8].seeds_skipped == got[8].n_seeds and got[8].candidates == 0
    assert {r.id for r in search.top_candidates(search.shared_counts(search.hits(wanted, posted))).collect()} == {0}
    # 20,000 copies are searched: the cap is the most that a bucket may hold
    fewer = posted.filter("id <= 20000")
    assert search.hits(wanted, fewer).filter("query = 8").select("id").distinct().count() == 20_000
    for n, want in ((2000, 2000), (2001, 0)):  # and so for seeds
        assert search.hits_by_seed(wanted, posted.filter(F.col("id").between(1, n))).filter("query = 8").select("id").distinct().count() == want
    posted.unpersist()


def test_tables_go_with_the_application(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').getOrCreate()
from strandlake.functions.store import materialise, shared_dir
print(materialise(spark.range(5)).count(), len(materialise(spark.range(0)).inputFiles()))
spark.range(3).write.parquet(shared_dir(spark))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert out.stdout.split()[0] == "5", out.stderr[-2000:]
    kept = list((tmp_path / "shared" / "tables").iterdir())
    assert len(kept) == 1  # what a caller asked a folder for stays
