"""The store of fetched alignments: repeated and concurrent writes, what it reads, builds through it."""

import re

from pyspark.sql import functions as F

from strandlake.functions import headers
from strandlake.plans import engine
from strandlake.sources import alignments


def frame(spark, rows):
    return spark.createDataFrame(rows, "acc string, text string")


def accs(spark, names):
    return spark.createDataFrame([(n,) for n in names], "acc string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_the_store_adds_what_it_lacks(spark, tmp_path):
    path = str(tmp_path / "store")
    msas = frame(spark, [("a", ">a\nA"), ("b", ">b\nB"), ("b", ">b\nC"), ("c", ">c\nC"), (None, ">n\nN"), ("e", None)])
    assert got(alignments.fetch_cached(msas, accs(spark, ["z"]), path)) == []
    assert alignments.add_missing(msas, accs(spark, ["a", "b", "b", None, "z", "e"]), path) == 2
    assert got(alignments.fetch_cached(msas, accs(spark, ["b", "c", "c", None]), path)) == [("b", ">b\nC"), ("c", ">c\nC")]
    # a text that is stored is not looked up again, and nothing is written
    files = set(alignments.stored(spark, path).inputFiles())
    assert got(alignments.fetch_cached(msas.limit(0), accs(spark, ["a", "b", "c"]), path, keep=True)) == [("a", ">a\nA"), ("b", ">b\nC"), ("c", ">c\nC")]
    assert set(alignments.stored(spark, path).inputFiles()) == files
    assert got(alignments.fetch_cached(msas, accs(spark, []), path)) == []


def test_repeated_and_concurrent_writes_leave_one_row_each(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    msas = frame(spark, [(f"a{i}", f">a{i}\nA") for i in range(300)])
    some, others = accs(spark, [f"a{i}" for i in range(200)]), accs(spark, [f"a{i}" for i in range(100, 300)])
    alignments.add_missing(msas, some, path)
    real = alignments.stored
    # callers that began before the first one wrote: one does the same batch again, one another that overlaps it
    monkeypatch.setattr(alignments, "stored", lambda spark, path: None)
    assert alignments.add_missing(msas, some, path) == 200
    assert real(spark, path).count() == 200
    assert alignments.add_missing(msas, others, path) == 200
    monkeypatch.setattr(alignments, "stored", real)
    assert real(spark, path).count() == 400
    assert got(alignments.fetch_cached(msas, accs(spark, [f"a{i}" for i in range(300)]), path)) == got(msas)
    # a write that died after some of its folders: the next adds the rest
    half = real(spark, path).filter("slot < 20").select("acc", "text", "slot", "batch")
    torn = str(tmp_path / "torn")
    half.write.partitionBy("slot", "batch").parquet(torn)
    assert alignments.add_missing(msas, msas, torn) == 300 - half.select("acc").distinct().count()
    assert got(alignments.fetch_cached(msas.limit(0), msas, torn)) == got(msas)


def test_reads_prune_slots(spark, tmp_path):
    path = str(tmp_path / "store")
    msas = frame(spark, [(f"a{i}", f">a{i}\nA") for i in range(300)])
    alignments.add_missing(msas, msas, path)
    read = alignments.fetch_cached(msas, accs(spark, ["a7"]), path)
    slot = spark.sql("SELECT 'a7' AS acc").select(alignments.slot_of(F.col("acc")).alias("s")).first().s
    plan = read._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [line for line in plan.splitlines() if line.startswith("PartitionFilters:")]
    assert scans and all(re.search(rf"slot#\d+ = {slot}\)", x) for x in scans)


def test_builds_read_through_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    base = spark.createDataFrame([(i, "".join("ACDEFGHIKLMNPQRSTVWY"[(j * j + 7 * i + j // 3) % 20] for j in range(200))) for i in range(4)], "id long, seq string")
    corpus = base.unionByName(base.select((F.col("id") + 10).alias("id"), headers.mutated("seq", "id", 0.03).alias("seq"))).selectExpr("id", "seq", "concat('E', id) AS acc", "'d' AS descr", "'o' AS organism", "'9' AS taxid")
    msas = corpus.select("acc", F.concat(F.lit(">q\n"), "seq", F.lit("\n>m_"), "acc", F.lit("\n"), F.reverse("seq"), F.lit("\n")).alias("text"))
    plain = engine.build_msa(base, corpus, msas, donors=2, exclude_self=True)
    through = engine.build_msa(base, corpus, msas, donors=2, exclude_self=True, store=path)
    assert got(through) == got(plain) and plain.count() > 4
    kept = alignments.stored(spark, path)
    assert kept.count() == plain.select("donor").filter("donor IS NOT NULL").distinct().count()
    # the texts of a second build come from the store alone
    assert got(engine.build_msa(base, corpus, msas.withColumn("text", F.lit(">x\nA\n")), donors=2, exclude_self=True, store=path)) == got(plain)
