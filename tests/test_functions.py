"""Golden values and properties of seeding, alignment, transfer, folds and readers."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import frames, headers, ranges, seeding
from strandlake.functions.align import local_alignments
from strandlake.functions.seeding import seed_arrays, seeds
from strandlake.operators import evaluation, index, msa, pairing, search
from strandlake.plans import engine
from strandlake.sources import corpus as src
from strandlake.streaming.chains import stream_hits

HBA = "MVLSPADKTNVKAAWGKVGAHAGEYGAEALERMFLSFPTTKTYFPHFDLSHGSAQVKGHGKKVADALTNAVAHVDDMPNALSALSDLHAHKLRVDPVNFKLLSHCLLVTLAAHLPAEFTPAVHASLDKFLASVSTVLTSKYR"
HBB = "MVHLTPEEKSAVTALWGKVNVDEVGGEALGRLLVVYPWTQRFFESFGDLSTPDAVMGNPKVKAHGKKVLGAFSDGLAHLDNLKGTFATLSELHCDKLHVDPENFRLLGNVLVCVLAHHFGKEFTPPVQAAYQKVVAGVANALAHKYH"
HBA_SEEDS = [29681893, 26489334, 513265103, 123583631, 163597495, 270861772, 312296014, 157874018, 814564, 374083322, 159910493, 391485862]
HBB_SEEDS = [334228980, 237603968, 325443102, 78576232, 69282270, 44448480, 94237160, 74831242, 393739155, 157963630, 141344721, 1294351653]


def seeds_of(spark, *seqs):
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string").select("id", seeds("seq").alias("s")).collect()
    return [r.s for r in sorted(rows)]


def test_seeds(spark):
    got = seeds_of(spark, HBA, HBB, "A" * 600, "X" * 142, "", "ACDEFGHIK", (HBA * 9)[:1200], "ACDEFGHIKL")
    assert got[0] == HBA_SEEDS and got[1] == HBB_SEEDS and got[2] == [315240206] and got[3] == got[4] == got[5] == []
    assert set(got[6]) == {814564, 12585602} and len(got[7]) == 0


@pytest.mark.parametrize("options", [{}, {"w": 11}, {"target": 20}, {"k": 6}])
def test_batched_seeds_equal_the_native_ones(spark, options):
    r = random.Random(3)
    rows = [(i, "".join(r.choices("ACDEFGHIKLMNPQRSTVWY" + "X" * (i % 3 == 0) + "é" * (i % 7 == 0), k=r.choice([0, 3, 9, 10, 11, 12, 13, 40, 100, 700])))) for i in range(300)]
    df = spark.createDataFrame([*rows, (9999, None)], "id long, seq string").repartition(3)
    assert df.filter(~seeds("seq", **options).eqNullSafe(seed_arrays("seq", **options))).count() == 0


def test_batches_are_cut_between_sequences():
    texts = [HBA.encode(), b"", b"ACD", HBB.encode(), HBA.encode()]
    assert [x.tolist() for x in seeding._chunk_seeds(texts, 10, 12, None)] == [HBA_SEEDS, [], [], HBB_SEEDS, HBA_SEEDS]
    assert [x.tolist() for x in seeding._chunk_seeds([b"", b"A"], 10, 12, None)] == [[], []]


@pytest.mark.parametrize("query,target,want", [
    (HBA, HBA, (733, 1, 142, 1, 142, 142, 100.0, 1.0)),
    (HBA, HBB, (288, 3, 141, 4, 146, 145, 43.448, 0.979)),
    (HBA[:50] + "W" * 7 + HBA[50:], HBA, (716, 1, 149, 1, 142, 149, 95.302, 1.0)),
    (HBA[40:100], HBA, (317, 1, 60, 41, 100, 60, 100.0, 1.0)),
    (HBA[:21] + "HQATI" + HBA[21:], HBA, (718, 1, 147, 1, 142, 147, 96.599, 1.0)),
])
def test_alignment(query, target, want):
    qseq, hseq, q_from, h_from, q_to, h_to, score, size, identity, coverage = local_alignments([query, "", "W"], [target, target, "A"])[0]
    assert (score, q_from, q_to, h_from, h_to, size) == want[:6] and identity == pytest.approx(want[6], abs=1e-3) and coverage == pytest.approx(want[7], abs=1e-3)
    assert qseq.replace("-", "") == query[q_from - 1 : q_to] and hseq.replace("-", "") == target[h_from - 1 : h_to]


def test_alignment_by_any_stride():
    r = random.Random(8)
    pairs = [("".join(r.choices("ACDEFGHIKL", k=r.randint(0, 60))), "".join(r.choices("ACDEFGHIKL", k=r.randint(0, 60)))) for _ in range(40)] + [(HBA, HBB), (HBA[:30] * 2, HBA)]
    one = local_alignments(*zip(*pairs), stride=10_000)
    assert all(local_alignments(*zip(*pairs), stride=s) == one for s in (1, 2, 7, 50))
    assert [local_alignments([q], [t])[0] for q, t in pairs] == one


def test_long_alignments_in_bounded_memory():
    import tracemalloc

    r = random.Random(5)
    long = "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=3000))
    tracemalloc.start()
    got = local_alignments([long], [long[:1500] + "W" * 5 + long[1500:]])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[4:6] == (3000, 3005) and got[8] > 99 and most < 12e6  # all ways at once take 18 MB


def test_alignment_edges():
    assert local_alignments(["", "A", "W"], ["A", "", "A"]) == [None, None, None] and local_alignments([], []) == []


def brute_transfer(row, qseq, hseq, q_from, h_from, q_len, h_len):
    """The row letter by letter: where each of its columns lands, and what waits in between."""
    q, h, lands = q_from - 1, h_from - 1, {}
    for a, b in zip(qseq, hseq):
        if a != "-" != b and h < h_len and q < q_len:
            lands[h] = q
        q, h = q + (a != "-"), h + (b != "-")
    spots = [["", "-"] for _ in range(q_len)] + [["", ""]]
    column, wait, some = 0, "", False
    for c in row:
        if c.islower() and c.isascii():
            wait += c
        elif column in lands and column < h_len:
            spots[lands[column]] = [wait, c]
            some, wait, column = some or c != "-", "", column + 1
        else:
            wait, column = wait + (c.lower() if c not in "-." else ""), column + 1
    spots[-1][0] = wait
    return "".join(a + b for a, b in spots) if some else None


def moved(spark, cases):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, seq string, qseq string, hseq string, q_from int, h_from int, q_len int, h_len int")
    got = {r.i: r.moved for r in msa.transfer_rows(rows).select("i", "moved").collect()}
    return [got.get(i) for i in range(len(cases))]


def test_transfer(spark):
    rows = [HBA, HBA[:70].lower() + HBA[70:], "-" * 10 + HBA[10:], HBA[:5] + "xyz" + HBA[5:]]
    same = [r for r in rows if sum(not c.islower() for c in r) == 142]
    assert moved(spark, [(r, HBA, HBA, 1, 1, 142, 142) for r in same]) == same  # the identity is a no-op
    short = (HBA[20:], HBA[20:], 1, 21, 122, 142)
    got = moved(spark, [(HBA, *short), ("-" * 142, *short), (HBA[:20] + "-" * 122, *short), (HBA, HBA, HBA, 11, 1, 162, 142)])
    assert got == [HBA[:20].lower() + HBA[20:], None, None, "-" * 10 + HBA + "-" * 10]


def test_transfer_against_letters(spark):
    r = random.Random(4)
    cases = []
    for _ in range(400):
        n = r.randint(1, 12)
        cols = [r.choice(["both"] * 4 + ["q", "h", "none"]) for _ in range(n)]
        qseq, hseq = ("".join(r.choice("ACDE") if c in ("both", x) else "-" for c in cols) for x in "qh")
        q_from, h_from = r.randint(1, 4), r.randint(1, 4)
        q_len, h_len = (max(0, f + sum(c != "-" for c in s) + r.randint(-2, 3)) for f, s in ((q_from, qseq), (h_from, hseq)))
        row = "".join(r.choice(["", "", "x", "yz"]) + r.choice("ACDEFGHIK--.") for _ in range(max(0, h_len + r.choice([0, 0, 0, -3, 2])))) + r.choice(["", "w"])
        cases.append((row, qseq, hseq, q_from, h_from, q_len, h_len))
    assert moved(spark, cases) == [brute_transfer(*c) for c in cases]


def test_folds():
    assert frames.greedy_dedup("Q", [("A", "1"), ("B", "1"), ("B", "2")]) == ["kept", "dup_seq", "kept"]
    assert frames.greedy_dedup("Q", [("A", "Q"), ("A", "2"), ("A", "3")]) == ["dup_seq", "kept", "dup_id"]
    assert frames.greedy_dedup("Q", [("A", "1"), ("B", "2")], 2) == ["kept", "capped"]
    near = HBA[:140] + "AA"
    assert frames.diverse([HBA, near, HBB]) == [-1, 0, -1] and frames.diverse([HBA, near], 1.01) == [-1, -1] and frames.diverse([HBA, HBB], 0.9, 1) == [-1, None]


def test_headers(spark):
    h = "UniRef90_X/2-139 [sub] Tax=Monodon monoceros TaxID=40151"
    df = spark.createDataFrame([(h, "ACdefG-"), ("plain", "")], "h string, s string")
    got = df.select(headers.taxid_of(F.col("h")), headers.organism_of(F.col("h")), headers.member_id_of(F.col("h")), headers.match_states(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("40151", "Monodon monoceros", "UniRef90_X/2-139", 4), (None, None, "plain", 0)]
    headers.register(spark)
    assert spark.sql(f"SELECT taxid_of('{h}'), match_states('ACdefG-')").first()[:] == ("40151", 4)


def test_readers(spark, tmp_path):
    (tmp_path / "c.fasta").write_text(">x1 UA=P1 d\nACDE\nFGH\n>x2 none\nAAA\n>x3 UA=P3\nKLM\n")
    assert sorted((r.acc, r.seq) for r in src.read_fasta(spark, str(tmp_path / "c.fasta")).collect()) == [("P1", "ACDEFGH"), ("P3", "KLM")]
    (tmp_path / "a.a3m").write_text("junk\n>q\nAC\n DE \n\n>r TaxID=5\nacDE\n")
    got = src.parse_a3m(src.read_a3m_folder(spark, str(tmp_path))).orderBy("row_ord").collect()
    assert [(r.msa_id, r.name, r.seq) for r in got] == [("a", "q", "ACDE"), ("a", "r TaxID=5", "acDE")]
    (tmp_path / "d.csv").write_text("A,5\nB,x\nC,7.5\n")
    assert sorted((r.acc, r.depth) for r in src.read_depths(spark, str(tmp_path / "d.csv")).collect()) == [("A", 5.0), ("C", 7.5)]
    text = [(1, "ACDEF"), (2, "ACDEF:GHIKL"), (3, ">one\nACD\nefg*\n>\nKL"), (4, "ACDE123"), (5, " ")]
    got = src.parse_query_input(spark.createDataFrame(text, "query_id long, text string")).orderBy("query_id", "chain_ord").collect()
    assert [(r.query_id, r.name, r.seq, r.valid) for r in got] == [(1, "chain_1", "ACDEF", True), (2, "chain_1", "ACDEF", True), (2, "chain_2", "GHIKL", True), (3, "one", "ACDEFG", True), (3, "chain_2", "KL", True), (4, "chain_1", "ACDE123", False)]
    assert [r.error for r in got if r.error] == ['"chain_1" contains non-amino-acid characters']
    odd = src.parse_query_input(spark.createDataFrame([(1, ">\n>\nKL"), (2, "A::B"), (3, ">x\n\n>y\nA\n>\nC")], "query_id long, text string")).orderBy("query_id", "chain_ord")
    assert [(r.name, r.seq) for r in odd.collect()] == [("chain_1", "KL"), ("chain_1", "A"), ("chain_3", "B"), ("y", "A"), ("chain_2", "C")]
    assert src.checked_chains(odd).count() == 5
    with pytest.raises(Exception, match="chain_1.* contains non-amino-acid"):
        src.checked_chains(src.parse_query_input(spark.createDataFrame([(4, "ACDE123")], "query_id long, text string"))).collect()


def test_index_round_trip(spark, tmp_path):
    r = random.Random(9)
    other = [(i, "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=120)), f"R{i}") for i in range(10, 400)]
    corpus = spark.createDataFrame([(0, HBA, "A"), (1, HBB, "B"), (2, HBA[:100], None), *other], "id long, seq string, acc string")
    index.write_index(corpus, str(tmp_path / "ix"), per_file=500)
    with pytest.raises(ValueError):
        index.assert_index_compatible(spark.sql("SELECT 9 AS k, 12 AS targetSeeds"))
    found = index.Index(spark, str(tmp_path / "ix"))
    posted = index.postings(corpus).collect()
    assert found.meta["nPost"] == len(posted) and found.meta["nSeq"] == corpus.count() and (found.meta["shift"], found.meta["postBytes"]) == (6, 5)
    files = found.meta["files"]
    assert len(files) > 5 and files[0]["postFrom"] == 0 and files[-1]["postTo"] == len(posted)
    assert all(a["postTo"] == b["postFrom"] and a["toBucket"] <= b["fromBucket"] for a, b in zip(files, files[1:]))
    for p in posted:
        f = files[[x["fileNo"] for x in files].index(found.file_for(p.bucket))]
        assert f["fromBucket"] <= p.bucket < f["toBucket"]
    assert found.file_for(files[0]["fromBucket"] - 1) is None and found.file_for(1 << 25) is None
    chains = spark.createDataFrame([(7, HBA)], "id long, seq string")
    top = search.search_index(found, chains).orderBy("rank").collect()
    assert (top[0].id, top[0].acc, top[0].shared) == (0, "A", 12) and 2 not in [t.id for t in top]  # no accession
    wanted = found.seeds(chains)
    near, offsets = found.near(wanted)
    buckets = {r.bucket for r in wanted.collect()}
    assert {r.bucket for r in near.collect()} == buckets == {r.bucket for r in offsets.collect()}
    plan = near._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "PartitionFilters" in x)
    assert "file_no" in scan.split("PartitionFilters")[1].split("]")[0] and "bucket" in scan.split("PushedFilters")[1]
    read = [x for x in near.inputFiles()]
    assert len({x.split("file_no=")[1].split("/")[0] for x in read}) >= len(files) > len({found.file_for(b) for b in buckets})
    found.named = 3  # more buckets than are named: a join
    assert {r.bucket for r in found.near(wanted)[0].collect()} == buckets
    whole = index.postings(corpus)
    assert search.hits(wanted, whole, 0).count() == 0 and search.hits(wanted, whole).count() == search.hits(wanted, near, offsets=offsets).count()


def test_shards_and_cache(spark, tmp_path):
    shards = [spark.createDataFrame([(i,) for i in x], "id long") for x in ((5, 3), (1,), (9, 7))]
    assert [(r.dense_id, r.id) for r in src.concat_shards(shards, "id").orderBy("dense_id").collect()] == [(0, 3), (1, 5), (2, 1), (3, 7), (4, 9)]
    msas = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "acc string, text string")
    path = str(tmp_path / "store")
    for names, stored in ((["a", "x"], 1), (["a", "b"], 2)):
        wanted = spark.createDataFrame([(x,) for x in names], "acc string")
        assert {r.acc for r in src.fetch_cached(msas, wanted, path).collect()} == set(names) - {"x"}
        assert spark.read.parquet(path).count() == stored


def test_studies_against_brute_force(spark):
    r = random.Random(6)

    def changed(seq, rate):
        return "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") if r.random() < rate else c for c in seq)

    entries = [(i, "".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=150))) for i in range(8)]
    members = [(i, 100 * i + k, changed(s, 0.04 * k)) for i, s in entries for k in range(12 if i else 5)]
    corpus = spark.createDataFrame(entries, "id long, seq string")
    queries = [(m, s) for _, m, s in members] + [(9999, "W" * 80)]
    seeds_at = {(x, w): {q.id: set(q.s) for q in spark.createDataFrame(y, "id long, seq string").select("id", seeds("seq", w=w).alias("s")).collect()} for x, y in (("c", entries), ("q", queries)) for w in (32, 8)}

    def best(q, seq, w):
        shared = {i: len(s & seeds_at["q", w][q]) for i, s in seeds_at["c", w].items()}
        top = sorted((i for i in shared if shared[i]), key=lambda i: -shared[i])[:10]
        return [a[8] for i in top if (a := local_alignments([seq], [dict(entries)[i]])[0])]

    got = evaluation.coverage_study(spark.createDataFrame(queries, "id long, seq string"), corpus).first()
    want = sorted(max(best(q, s, 32), default=0.0) for q, s in queries)
    assert (got.n, got.at_90, got.at_70, got.at_50) == (len(want), *(sum(x >= t for x in want) for t in (90, 70, 50))) and got.median == pytest.approx(want[len(want) // 2])
    rows = evaluation.recall_study(spark.createDataFrame(members, "family long, member long, seq string"), corpus, per_band=99, per_family=99).collect()
    tally = {}
    for f, m, s in members:
        own = local_alignments([s], [dict(entries)[f]])[0]
        if f and own and own[9] >= 0.5:
            band = next(i for i, (a, b) in enumerate(zip(evaluation.BINS, evaluation.BINS[1:])) if a <= own[8] < b)
            n, fams, hits = tally.setdefault(band, [0, set(), 0])
            tally[band] = [n + 1, fams | {f}, hits + any(x >= own[8] - 2 for x in best(m, s, 8))]
    assert {r.band: (r.n, r.families, r.hits) for r in rows} == {b: (n, len(f), h) for b, (n, f, h) in tally.items()} and len(tally) > 2


def test_borrowed_alignments(spark):
    """Several donors, a depth limit, statistics, no entry for itself; every row has the query's columns."""
    far = "".join(random.Random(1).choices("ACDEFGHIKLMNPQRSTVWY", k=60))
    variant = HBA[:60] + far + HBA[60:]
    corpus = spark.createDataFrame([(1, "A", HBA, "d", "o", "9"), (2, "B", HBA[:130], "d", "o", "9"), (3, "C", variant, "d", "", None), (4, "D", HBA, None, None, None)], "id long, acc string, seq string, descr string, organism string, taxid string")
    msas = spark.createDataFrame([("B", f">query\n{HBA[:130]}\n>m1 TaxID=1\n{HBA[:40]}abc{HBA[40:130]}\n>m2 TaxID=2\n{'-' * 60}{HBA[60:130]}\n"), ("C", f">query\n{variant}\n>m1 TaxID=1\n{variant}\n>m3 TaxID=3\n{'-' * 100}{variant[100:]}\n")], "acc string, text string")
    chains = spark.createDataFrame([(1, HBA)], "id long, seq string")
    options = {"donors": 2, "exclude_self": True, "max_pair_identity": 1.01}
    rows = engine.build_msa(chains, corpus, msas, **options).orderBy("row_ord").collect()
    assert rows[0].seq == HBA and {r.donor for r in rows[1:]} == {"B", "C"} and len(rows) == 6  # the second m1 goes
    assert all(r.n_match == len(HBA) for r in rows) and [r.name.split(" ")[0] for r in rows[1:]] == ["B", "m1", "m2", "C", "m3"]
    assert rows[2].seq == HBA[:40] + "abc" + HBA[40:130] + "-" * 12
    assert engine.build_msa(chains, corpus, msas, max_depth=3, **options).count() == 3
    stats = [(s.acc, s.added, s.total, s.dup_id, s.dup_seq) for s in engine.donor_stats(chains, corpus, msas, **options).orderBy("donor_ord").collect()]
    assert stats == [("B", 3, 3, 0, 0), ("C", 2, 3, 1, 0)]
    alike = engine.build_msa(chains, corpus, msas, donors=2, exclude_self=True)
    assert {r.donor for r in alike.collect()} == {None, "B"} and engine.build_msa(chains, corpus, msas.filter("acc = 'C'")).filter("donor = 'C'").count() > 0


def test_json_keeps_the_last_of_a_name(spark):
    rows = [("q", 0, "x", ">x\nA\n"), ("q", 1, "y", ">y\nC\n"), ("q", 2, "x", ">x\nD\n")]
    got = src.json_response(spark.createDataFrame(rows, "query_id string, chain_ord int, name string, text string")).first().body
    assert got == '{"x":">x\\nD\\n","y":">y\\nC\\n"}'


def test_sources_of_the_studies(spark, tmp_path):
    import gzip

    (tmp_path / "sp.fasta").write_text(">sp|P1|X d\n" + HBA[:70] + "\n" + HBA[70:] + "\n>tr|P2|Y\nACD\n>junk\n" + HBA + "\n")
    assert [(r.acc, r.seq) for r in src.read_swissprot(spark, str(tmp_path / "sp.fasta")).collect()] == [("P1", HBA)]
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write("r1\te1\t0\t9\nr1\tr1\t0\t9\n")
    assert sorted((r.rep, r.entry) for r in src.read_clusters(spark, str(tmp_path / "c.tsv.gz")).collect()) == [("r1", "e1"), ("r1", "r1")]


def test_streamed_chains(spark, tmp_path):
    posted = index.postings(spark.createDataFrame([(0, HBA)], "id long, seq string"))
    spark.createDataFrame([(5, HBA)], "id long, seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, seq string").parquet(str(tmp_path / "in"))
    run = stream_hits(stream, posted).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("streamed").count() == 12
    again = stream_hits(stream, posted.unionByName(posted.filter("ord < 3")), cap=1).writeStream.format("memory").queryName("capped").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    again.awaitTermination(60)
    assert sorted(r["ord"] for r in spark.table("capped").collect()) == list(range(3, 12))  # the others' buckets are too large


def test_selection_and_medians(spark):
    depths = spark.createDataFrame([("a", 500.0), ("b", 900.0), ("c", 300.0), ("d", 200.0), ("e", 150.0), ("f", 50.0)], "acc string, depth double")
    clusters = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "rep string, entry string")
    assert [r.acc for r in evaluation.select_entries(depths, clusters, 3).orderBy("rank").collect()] == ["b", "c", "d"]
    assert evaluation.upper_median(spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("x", 4)], "k string, v int"), "k", "v").first().upper_median == 3
    many = spark.createDataFrame([(None if i % 3 else "x", float(i * 37 % 101)) for i in range(500)], "k string, v double")
    got = {r.k: (r.n, r.upper_median) for r in evaluation.upper_median(many, "k", "v").collect()}
    assert got == {k: (len(v), sorted(v)[len(v) // 2]) for k in ("x", None) for v in [[float(i * 37 % 101) for i in range(500) if (i % 3 == 0) == (k == "x")]]}


def test_numbering_of_a_hot_group(spark):
    rows = [("hot" if i % 5 else None, i * 7919 % 1009) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long")
    got = {(r.g, r.o): r.n for r in ranges.numbered(df, "g", "o", "n").collect()}
    want = {(g, o): n for g in ("hot", None) for n, o in enumerate(sorted(o for k, o in rows if k == g))}
    assert got == want
    ids = {(r.g, r.o): r.dense_id for r in src.dense_ids(df, "g", "o").collect()}
    assert ids == {k: n for n, k in enumerate(sorted(want, key=lambda k: (k[0] is not None, k[0] or "", k[1])))}
    assert ranges.numbered(df.limit(0), "g", "o", "n").count() == 0


def test_best_of_each_taxon(spark):
    rows = [("q", 0, 1, "a", "AA", "9", 0.5), ("q", 0, 2, "b", "BB", "9", 0.7), ("q", 0, 3, "c", "CC", "9", 0.7), ("q", 0, 4, "d", "DD", None, 1.0)]
    got = pairing.best_per_taxon(spark.createDataFrame(rows, "query_id string, chain int, row_ord int, name string, seq string, taxid string, identity double")).collect()
    assert [(r.row_ord, r.name, r.seq, r.seen) for r in got] == [(2, "b", "BB", 1)]


def test_study_helpers(spark, tmp_path):
    df = spark.createDataFrame([(i, HBA) for i in range(60)] + [(99, "ACDX" * 20)], "id long, seq string")
    moved = df.select("id", "seq", headers.mutated("seq", "id", 0.05).alias("m")).collect()
    share = sum(a != b for r in moved for a, b in zip(r.seq, r.m, strict=True)) / sum(len(r.seq) for r in moved)
    assert 0.03 < share < 0.07 and all(len(r.seq) == len(r.m) and r.seq.count("X") == r.m.count("X") for r in moved)
    assert src.packed_scan(df).count() == 60 and src.packed_scan(df, most=5).count() == 5
    assert src.sample_rows(df, "id", 7).exceptAll(src.sample_rows(df.repartition(5), "id", 7)).count() == 0
    ranked = spark.createDataFrame([("a", 9.0, 1), ("b", 5.0, 2), ("c", 4.0, 3), ("d", 1.0, 4)], "acc string, depth double, rank int")
    assert evaluation.depth_summary(ranked).first()[:] == (4, 9.0, 4.0, 1.0)
    src.write_entry_list(ranked, str(tmp_path / "list"))
    assert [r.value for r in spark.read.text(str(tmp_path / "list")).collect()] == ["a", "b", "c", "d"]
    flags = spark.createDataFrame([(95.0, 0.9), (80.0, 0.7)], "i double, c double").select(*headers.hit_warnings(F.col("i"), F.col("c"))).collect()
    assert [tuple(r) for r in flags] == [(False, False), (True, True)]
    assert spark.range(1).select(headers.file_name(F.lit("a b/c"))).first()[0] == "a_b_c"
    few = evaluation.quota_per_band(spark.createDataFrame([("f", i, 95.0 + i % 2 - 20 * (i % 3)) for i in range(30)], "family string, member int, identity double"), 2, 3)
    assert few.count() == 3
    heads, paired = spark.createDataFrame([("q", "#2,2\t1,1")], "query_id string, header string"), spark.createDataFrame([("q", 2, "n", "CC"), ("q", 1, "m", "AA")], "query_id string, paired_ord int, name string, seq string")
    rest = spark.createDataFrame([("q", 1, 3, "z", "--DD"), ("q", 0, 5, "y", "DD--")], "query_id string, chain int, row_ord int, name string, seq string")
    own = spark.createDataFrame([("q", 1, "KL"), ("q", 0, "HI")], "query_id string, chain int, seq string")
    assert src.format_paired_a3m(heads, own, paired, rest).first().text == "#2,2\t1,1\n>101\nHIKL\n>m\nAA\n>n\nCC\n>y\nDD--\n>z\n--DD\n"
    assert src.format_paired_a3m(heads, own, paired.limit(0), rest.limit(0)).first().text == "#2,2\t1,1\n>101\nHIKL\n"
    few = pairing.paired_block(pairing.best_per_taxon(spark.createDataFrame([("q", c, i, f"n{i}", "AA", str(i), 0.1 * i) for c in (0, 1) for i in range(5)], "query_id string, chain int, row_ord int, name string, seq string, taxid string, identity double")), spark.createDataFrame([("q", 2)], "query_id string, n_chains int"), max_paired=2)
    assert sorted((r.paired_ord, r.taxid) for r in few.collect()) == [(1, "4"), (2, "3")]
    wanted, posted = index.postings(df.filter("id = 3")), index.postings(df)
    assert search.hits_by_seed(wanted, posted, 60).count() == 720 and search.hits_by_seed(wanted, posted, 59).count() == 0
    headers.register(spark)
    got = spark.sql(f"SELECT size(seeds('{HBA}')), sw_align('{HBA}', '{HBB}').score, organism_of('x Tax=A b TaxID=1'), paired_header(array(3, 4))").first()
    assert got[:] == (12, 288, "A b", "#3,4\t1,1")
