"""Searches and alignments in SQL alone, by the registered functions."""

from pyspark.sql import functions as F

from strandlake.functions import headers
from strandlake.functions.align import local_alignments
from strandlake.functions.seeding import seed_arrays
from strandlake.operators import index, search
from strandlake.sources import corpus as src

SF = "/root/testdata/sf0.001"


def test_search_in_sql(spark):
    headers.register(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), src.letters(F.col("text")).alias("seq")).filter("length(seq) BETWEEN 40 AND 1500")
    docs.createOrReplaceTempView("entries")
    got = spark.sql("""
WITH p AS (SELECT id, s.pos AS ord, s.col AS seed FROM entries, LATERAL posexplode(seeds(seq)) s),
  hot AS (SELECT seed >> 6 AS bucket FROM p GROUP BY 1 HAVING count(*) > 20000),
  c AS (SELECT q.id AS query, t.id, count(*) AS shared, min(q.ord) AS first_ord FROM p q JOIN p t ON q.seed >> 6 = t.seed >> 6 AND q.seed & 255 = t.seed & 255
        WHERE q.id % 3 = 0 AND q.id <> t.id AND q.seed >> 6 NOT IN (SELECT bucket FROM hot) GROUP BY 1, 2),
  r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY shared DESC, first_ord, id) AS rank, id, shared FROM c)
SELECT * FROM r WHERE rank <= 20""")
    posted = index.postings(docs)
    want = search.top_candidates(search.shared_counts(search.hits(posted.filter("id % 3 = 0"), posted).filter("query <> id")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10
    other = {r.id: list(r.s) for r in spark.sql("SELECT id, seeds_with(seq, 8, 20) AS s FROM entries").collect()}
    assert other == {r.id: list(r.s) for r in docs.select("id", seed_arrays("seq", k=8, target=20).alias("s")).collect()}


def test_alignments_and_rows_in_sql(spark):
    headers.register(spark)
    texts = [("m1", "junk\n>q one\nACDE\n FGHI\t\n>r2\r\nAC-Ex\nFGHI\n\n>last"), ("m2", ""), ("m3", ">only\nWWWWHH")]
    spark.createDataFrame(texts, "msa_id string, text string").createOrReplaceTempView("msas")
    got = spark.sql("SELECT msa_id, r.row_ord, r.name, r.seq FROM msas, LATERAL parse_a3m(text) r")
    want = src.parse_a3m(spark.table("msas"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    pairs = [("ACDEFGHIKL" * 3, "ACDEFGHKL" * 3, 11, 1), ("ACDEFGHIKL" * 3, "ACDEFGHKL" * 3, 2, 1), ("W", "A", 11, 1), ("MKVLWAALLV", "MKVLAALLV", 3, 2)]
    spark.createDataFrame(pairs, "q string, t string, o int, e int").createOrReplaceTempView("pairs")
    rows = spark.sql("SELECT q, t, o, e, sw_score(q, t) AS score, sw_align(q, t) AS plain, sw_align_with(q, t, o, e) AS own FROM pairs").collect()
    assert len(rows) == 4
    for r in rows:
        plain, own = (local_alignments([r.q], [r.t], *c)[0] for c in ((), (r.o, r.e)))
        assert r.score == (plain[6] if plain else 0) and r.plain.score == (plain[6] if plain else None)
        assert tuple(r.own) == (own or (None,) * 10)
