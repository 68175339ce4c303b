"""The jobs by two runs over growing input, after crashes, and against a search by hand."""

import shutil
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import chain_search, common, index_refresh
from strandlake.functions.seeding import seed_rows
from strandlake.sources.corpus import letters

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def grown(spark, folder, low, high):
    documents(spark).filter(F.col("doc_id").between(low, high)).coalesce(2).write.mode("append").parquet(folder)


def stored(spark, out):
    index = index_refresh.read_index(spark, out)
    return Counter(map(tuple, index.postings.select("seed", "bucket", "residual", "id", "ord", "part").collect())), Counter(map(tuple, index.sizes.collect())), Counter(map(tuple, index.entries.select("id", "acc", "n").collect()))


def expected(spark, high):
    rows = documents(spark).filter(F.col("doc_id") <= high).select(F.col("doc_id").alias("id"), letters(F.col("text")).alias("seq")).filter(F.length("seq") >= 40)
    posted = Counter((r.seed, r.seed >> 6, r.seed & 255, r.id, r.ord, r.seed >> 25) for r in seed_rows(rows).collect())
    sizes = Counter()
    for (_, bucket, *_), n in posted.items():
        sizes[bucket] += n
    return posted, Counter(sizes.items()), Counter((r.id, f"D{r.id}", len(r.seq)) for r in rows.collect())


def test_index_grows_by_what_is_new(spark, tmp_path):
    corpus, out = str(tmp_path / "docs"), str(tmp_path / "index")
    conf = {"corpus": corpus, "output": out}
    grown(spark, corpus, 0, 90)
    first = index_refresh.refresh(spark, conf)
    assert first["run"] == 0 and first["n_rows"] == 91 and stored(spark, out) == expected(spark, 90)
    assert index_refresh.refresh(spark, conf)["n_rows"] == 0 and stored(spark, out) == expected(spark, 90)
    grown(spark, corpus, 91, 199)
    second = index_refresh.refresh(spark, conf)
    assert second["run"] == 1 and second["n_rows"] == 109 and stored(spark, out) == expected(spark, 199)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    assert index_refresh.refresh(spark, conf)["n_rows"] == 0
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")} == before


@pytest.mark.parametrize("after", ["entries", "postings", "sizes"])
def test_a_run_that_died_is_replaced(spark, tmp_path, after):
    corpus, out = str(tmp_path / "docs"), str(tmp_path / "index")
    conf = {"corpus": corpus, "output": out}
    grown(spark, corpus, 0, 60)
    index_refresh.refresh(spark, conf)
    grown(spark, corpus, 61, 120)
    index_refresh.refresh(spark, conf)
    for name in ("entries", "postings", "sizes", "marks")[("entries", "postings", "sizes").index(after) + 1 :]:
        shutil.rmtree(tmp_path / "index" / name / "run=1")  # what a run that died there hasn't written
    assert stored(spark, out) == expected(spark, 60)  # what it left isn't read
    grown(spark, corpus, 121, 150)  # and the input has grown meanwhile
    assert index_refresh.refresh(spark, conf)["run"] == 1 and stored(spark, out) == expected(spark, 150)


def test_rows_that_would_be_missed(spark, tmp_path):
    corpus, out = str(tmp_path / "docs"), str(tmp_path / "index")
    grown(spark, corpus, 20, 40)
    index_refresh.refresh(spark, {"corpus": corpus, "output": out})
    grown(spark, corpus, 10, 12)
    with pytest.raises(ValueError, match="3 rows came with ids up to the mark 40"):
        index_refresh.refresh(spark, {"corpus": corpus, "output": out})
    grown(spark, corpus, 41, 45)
    assert index_refresh.refresh(spark, {"corpus": corpus, "output": out, "late": "warn"})["late"] == 3
    with pytest.raises(ValueError, match="other bits"):
        index_refresh.refresh(spark, {"corpus": corpus, "output": out, "part_bits": 3})
    with pytest.raises(ValueError, match="no index"):
        index_refresh.read_index(spark, str(tmp_path / "nowhere"))


def test_odd_rows(spark, tmp_path):
    corpus, out = str(tmp_path / "docs"), str(tmp_path / "index")
    rows = [(1, None), (2, ""), (3, "ab 12"), (None, "treads " * 50), (4, "treads " * 50), (4, "treads " * 50), (5, "é" * 50)]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, acc string, part int").write.parquet(corpus)
    found = index_refresh.refresh(spark, {"corpus": corpus, "output": out})
    assert (found["n_rows"], found["without_id"], found["n_entries"]) == (6, 1, 2) and found["n_postings"] == 2 * len({s for s, *_ in stored(spark, out)[0]}) > 0
    spark.createDataFrame([(9, "short")], "doc_id long, text string").write.parquet(f"{corpus}2")  # entries without any seed
    found = index_refresh.refresh(spark, {"corpus": f"{corpus}2", "output": f"{out}2"})
    assert found["n_postings"] == 0 and not stored(spark, f"{out}2")[0] and index_refresh.refresh(spark, {"corpus": f"{corpus}2", "output": f"{out}2"})["n_rows"] == 0


def by_hand(spark, chains, index, k, cap):
    """(query, rank, id, shared) by dictionaries."""
    holders, sizes = defaultdict(list), Counter()
    for r in index.postings.collect():
        holders[r.bucket, r.residual].append(r.id)
        sizes[r.bucket] += 1
    seeds = defaultdict(list)
    for r in seed_rows(chains.filter(F.length("seq") >= 40)).orderBy("id", "ord").collect():
        seeds[r.id].append(r.seed)
    out, skipped = set(), Counter()
    for query, own in seeds.items():
        count, first = Counter(), {}
        for n, s in enumerate(own):
            skipped[query] += sizes[s >> 6] > cap
            for i in holders[s >> 6, s & 255] if sizes[s >> 6] <= cap else ():
                count[i] += 1
                first.setdefault(i, n)
        out |= {(query, rank, i, count[i]) for rank, i in enumerate(sorted(count, key=lambda i: (-count[i], first[i], i))[:k], 1)}
    return out, {q: (len(s), skipped[q]) for q, s in seeds.items()}


@pytest.mark.parametrize("cap", [20_000, 4])
def test_stream_takes_new_files_only(spark, tmp_path, cap):
    index, out, inbox = str(tmp_path / "index"), str(tmp_path / "found"), str(tmp_path / "inbox")
    index_refresh.refresh(spark, {"corpus": f"{SF}/documents.parquet", "output": index})
    # whole documents and pieces of them, one that is too short, one without an id
    chains = documents(spark).select((F.col("doc_id") * 10).alias("id"), F.substring("text", 30, 700).alias("seq")).unionByName(spark.createDataFrame([(5, "tiny"), (None, "treads " * 30), (15, None)], "id long, seq string"))
    conf = {"chains": inbox, "index": index, "output": out, "top_k": 3, "max_postings": cap}

    def found():
        return Counter((r.query, r.rank, r.id, r.shared) for r in spark.read.parquet(f"{out}/candidates").collect())

    def want(rows):
        return by_hand(spark, rows.filter("id IS NOT NULL").select("id", letters(F.coalesce("seq", F.lit(""))).alias("seq")), index_refresh.read_index(spark, index), 3, cap)

    early, late = chains.filter("id < 900"), chains.filter("id >= 900 OR id IS NULL")
    early.coalesce(1).write.parquet(inbox)
    assert chain_search.search_new(spark, conf)["batches"] == 1 and found() == Counter(want(early)[0])
    assert chain_search.search_new(spark, conf)["batches"] == 0 and found() == Counter(want(early)[0])
    late.coalesce(2).write.mode("append").parquet(inbox)
    second = chain_search.search_new(spark, conf | {"files_per_batch": 1})
    assert second["batches"] == 2 and second["chains"] == late.filter("id IS NOT NULL").count() and found() == Counter(want(chains)[0])
    lookups = {r.query: (r.n_seeds, r.seeds_skipped) for r in spark.read.parquet(f"{out}/lookups").collect()}
    seeds = want(chains)[1]
    assert lookups == {r.id: seeds.get(r.id, (0, 0)) for r in chains.filter("id IS NOT NULL").collect()}
    assert any(s for _, s in lookups.values()) == (cap == 4)
    # a batch that died before its commit is run again and replaces what it wrote
    for x in ("2", ".2.crc"):
        (tmp_path / "found" / "checkpoint" / "commits" / x).unlink()
    assert chain_search.search_new(spark, conf)["batches"] == 1 and found() == Counter(want(chains)[0])


def test_settings(tmp_path, monkeypatch):
    with pytest.raises(ValueError, match="unknown settings: typo"):
        common.settings(index_refresh.DEFAULTS, {"corpus": "x", "output": "y", "typo": 1})
    with pytest.raises(ValueError, match="without a value: corpus, output"):
        common.settings(index_refresh.DEFAULTS, {})
    seen = []
    monkeypatch.setattr("sys.argv", ["x", "jobs/index_refresh.json", "--set", "output=/o", "--set", "least=7"])
    monkeypatch.setattr(common, "SparkSession", type("S", (), {"builder": type("B", (), {"appName": lambda self, n: self, "getOrCreate": lambda self: type("T", (), {"stop": lambda self: seen.append("stopped")})()})()}))
    common.main("index_refresh", "", lambda spark, given: seen.append((given["output"], given["least"], given["corpus"])))
    assert seen == [("/o", 7, "/data/documents.parquet"), "stopped"]
