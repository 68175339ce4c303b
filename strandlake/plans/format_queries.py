"""Registered queries that go through files of the published formats, and of limits and folds; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headers
from ..functions.store import shared_dir
from ..operators import evaluation, index, msa, pairing, search
from ..sources import corpus as src
from ..sources import payloads
from .queries import _CHAINS, _DOCS, _IDENT, _PAIRS, _SELECTED, _TOP, _TURN_ROWS, _UNPAIRED, CORPUS_SEEDS, TOP, _chains, _counts, _depths, _paired, _rows, seed_sql, table

#: Limits of the queries here.
MOST_PAIRED, MAX_DEPTH, MAX_HITS, LIKE = 3, 3, 3, 0.2


def _letters(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.coalesce(src.letters(F.col("text")), F.lit("")).alias("seq"))


def swissprot_scan(spark, d):
    """Documents written as FASTA with database headers, 60 letters a line, and those of 30 letters and more read back."""
    path = shared_dir(spark)
    header = F.concat(F.lit(">sp|D"), "doc_id", F.lit("|N of "), F.coalesce("lang", F.lit("")))
    _letters(spark, d).select(F.concat(header, F.lit("\n"), F.regexp_replace("seq", "(.{60})(?!$)", "$1\n"))).write.text(path)
    return src.read_swissprot(spark, path).select("acc", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("md5"))


def entry_list(spark, d):
    """Depths in CSV, some of which are no numbers, and clusters in compressed TSV; the entries selected from them, as the list's file gives them."""
    path = shared_dir(spark)
    known = F.when(F.col("acc").cast("long") % 7 == 0, "NaN").otherwise(F.col("depth").cast("string"))
    _depths(spark, d).select("acc", known.alias("depth")).write.csv(f"{path}/depths")
    parts = table(spark, d, "part").select("p_brand", F.col("p_partkey").cast("string"), F.lit("0"), F.lit("9"))
    parts.write.option("sep", "\t").option("compression", "gzip").csv(f"{path}/clusters")
    clusters = src.read_clusters(spark, f"{path}/clusters").select("rep", "entry")
    src.write_entry_list(evaluation.select_entries(src.read_depths(spark, f"{path}/depths"), clusters, 60, 20), f"{path}/list")
    place = F.monotonically_increasing_id() + 1  # one small file: its lines in order
    return spark.read.text(f"{path}/list").select(place.cast("int").alias("rank"), F.col("value").alias("acc"))


def candidate_payloads(spark, d):
    """Documents as JSON answers: objects, arrays of two, some without a sequence, some that are no JSON."""
    key = F.col("doc_id")
    entry = F.struct(F.when(key % 11 != 0, F.col("seq")).alias("uniprotSequence"), F.col("lang").alias("uniprotDescription"), F.when(key % 3 != 0, F.col("source")).alias("organismScientificName"), (key % 5).alias("taxId"))
    other = F.struct(F.lit("ACD").alias("uniprotSequence"), F.lit("other").alias("uniprotDescription"), F.lit("other").alias("organismScientificName"), F.lit(1).cast("long").alias("taxId"))
    body = F.when(key % 7 == 0, "{no JSON").when(key % 2 == 0, F.to_json(entry)).otherwise(F.to_json(F.array(entry, other)))
    return payloads.parse_payloads(_letters(spark, d).select(F.concat(F.lit("D"), "doc_id").alias("acc"), body.alias("body")))


def shard_counters(spark, d):
    """The counters of documents in a shard for each language, as written beside the shards."""
    path = shared_dir(spark)
    index.write_shard_counters(_letters(spark, d).select(F.col("lang").alias("shard"), F.col("doc_id").alias("id"), "seq"), path)
    return index.read_shard_counters(spark, path)


def paired_lines(spark, d):
    """The lines of the paired alignments, written in pieces and read back."""
    path = shared_dir(spark)
    chains = _, lengths, first = _chains(spark, d)
    rows, _, best, paired = _paired(spark, d, chains)
    src.write_paired_a3m(pairing.paired_header(lengths), first.select("query_id", "chain", F.col("q").alias("seq")), paired, pairing.unpaired_block(rows, best, paired, lengths), path)
    return src.read_paired_a3m(spark, path)


def paired_limits(spark, d):
    _, lengths, best, _ = _paired(spark, d)
    return pairing.paired_block(best, lengths.select("query_id", F.size("lens").alias("n_chains")), MOST_PAIRED)


def capped_dedup(spark, d):
    rows = _rows(spark, d)
    return msa.greedy_dedup(rows.select(F.col("msa_id").alias("query_id"), F.lit("").alias("query"), "row_ord", headers.member_id_of(F.col("name")).alias("member"), "seq"), MAX_DEPTH)


def capped_diversity(spark, d):
    """A conversation's turns as hits of its first one, laid beside it with gaps at every 7th and 5th column."""
    rows = _rows(spark, d).select("msa_id", (F.col("row_ord") + 1).alias("hit_ord"), F.upper(F.regexp_replace("seq", "-", "")).alias("s"))
    first = rows.filter("hit_ord = 1").select("msa_id", F.col("s").alias("q"))

    def gapped(seq, step):
        return F.array_join(F.transform(F.split(F.left(seq, F.least(F.length("q"), F.length("s"))), ""), lambda c, i: F.when(i % step == step - 1, "-").otherwise(c)), "")

    hits = rows.join(first, "msa_id").filter("q <> '' AND s <> ''")
    hits = hits.select(F.col("msa_id").alias("query_id"), "hit_ord", F.concat_ws("_", "msa_id", "hit_ord").alias("acc"), gapped(F.col("q"), 7).alias("qseq"), gapped(F.col("s"), 5).alias("hseq"), (1 + F.col("hit_ord") % 3).alias("q_from"), F.length("q").alias("q_len"))
    return msa.diverse_hits(hits, LIKE, MAX_HITS)


def donor_by_seeds(spark, d):
    """Of each search's candidates the labelled one of most shared seeds."""
    top = search.top_candidates(_counts(spark, d), TOP).select("query", "rank", "id", F.concat(F.lit("D"), "id").alias("acc"), F.col("shared").alias("score"))
    labelled = table(spark, d, "labels").select(F.concat(F.lit("D"), "doc_id").alias("acc"))
    return msa.pick_donor(top, labelled).select("query", "id", "acc", "score")


def donor_labels(spark, d):
    """Labels of documents, of which some lack a description, an organism or a taxon."""
    key = F.col("doc_id")
    desc, organism = F.when(key % 3 != 0, F.col("lang")), F.when(key % 4 == 0, "").when(key % 4 != 1, F.col("lang"))
    taxid = F.when(key % 5 != 0, F.regexp_extract("source", "[0-9]+", 0))
    return table(spark, d, "documents").select("doc_id", headers.donor_label(F.concat(F.lit("D"), "doc_id"), desc, organism, taxid).alias("label"))


def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", headers.file_name(F.col("url")).alias("name"))


def row_warnings(spark, d):
    """Flags of turns beside their conversation's first, by identity and by the share of its length."""
    rows = _rows(spark, d)
    first = rows.filter("row_ord = 0").select("msa_id", F.upper("seq").alias("q")).filter("q <> ''")
    both = rows.filter("row_ord > 0").join(first, "msa_id")
    return both.select("msa_id", "row_ord", *headers.hit_warnings(100 * headers.identity_to_query(F.col("q"), F.upper("seq")), F.length("seq") / F.length("q")))


QUERIES = [
    swissprot_scan, entry_list, candidate_payloads, shard_counters, paired_lines, paired_limits, capped_dedup, capped_diversity, donor_by_seeds, donor_labels,
    file_names, row_warnings,
]

_HITS = f"""
g AS (SELECT msa_id, row_ord + 1 AS hit_ord, upper(replace(seq, '-', '')) AS s FROM ({_TURN_ROWS})), q AS (SELECT msa_id, length(s) AS ql FROM g WHERE hit_ord = 1),
h AS (SELECT msa_id, hit_ord, msa_id || '_' || hit_ord AS acc, ql, least(ql, length(s)) AS n, s FROM g JOIN q USING (msa_id) WHERE ql > 0 AND length(s) > 0),
b AS (SELECT *, repeat('-', hit_ord % 3) || array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: i % 7 <> 0), lambda i: CASE WHEN i % 5 = 0 THEN '-' ELSE s[i] END), '') AS body FROM h),
fr AS (SELECT msa_id, hit_ord, acc, rpad(left(body, ql), CAST(ql AS INTEGER), '-') AS f FROM b)"""

ORACLE = {
    "swissprot_scan": f"SELECT 'D' || id AS acc, CAST(length(seq) AS INTEGER) AS n, md5(seq) AS md5 FROM ({_DOCS}) WHERE length(seq) >= 30",
    "entry_list": f"SELECT rank, acc FROM ({_SELECTED.replace('FROM lineitem GROUP BY', 'FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY')})",
    "candidate_payloads": f"SELECT 'D' || doc_id AS acc, seq, coalesce(lang, '') AS descr, CASE WHEN doc_id % 3 <> 0 THEN coalesce(source, '') ELSE '' END AS organism, CASE WHEN doc_id % 5 = 0 THEN '' ELSE CAST(doc_id % 5 AS VARCHAR) END AS taxid FROM documents JOIN ({_DOCS}) ON id = doc_id WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND seq <> ''",
    "shard_counters": f"WITH {seed_sql(_DOCS)}, q AS (SELECT lang AS shard, n, count(seed) AS k FROM s_c JOIN documents ON doc_id = s_c.id LEFT JOIN s ON s.id = s_c.id GROUP BY s_c.id, 1, 2), c AS (SELECT shard, count(*) FILTER (WHERE n BETWEEN 40 AND 2000 AND k > 0) AS \"nSeq\", CAST(coalesce(sum(k) FILTER (WHERE n BETWEEN 40 AND 2000), 0) AS BIGINT) AS \"nPost\", count(*) FILTER (WHERE n < 40) AS \"tooShort\", count(*) FILTER (WHERE n > 2000) AS \"tooLong\", count(*) FILTER (WHERE n BETWEEN 40 AND 2000 AND k = 0) AS \"badChars\" FROM q GROUP BY 1) SELECT *, 10 AS k, 12 AS \"targetSeeds\", CASE WHEN \"nSeq\" = 0 THEN 0 ELSE \"nPost\" / \"nSeq\" END AS \"seedsPerSeq\" FROM c",
    "paired_lines": f"WITH {_CHAINS}, {_UNPAIRED}, ro AS (SELECT query_id, '101' AS name, string_agg(q, '' ORDER BY chain) AS seq FROM fq GROUP BY 1 UNION ALL SELECT query_id, name, seq FROM pa UNION ALL SELECT query_id, name, seq FROM un) SELECT query_id AS msa_id, unnest(['>' || name, seq]) AS line FROM ro UNION ALL SELECT query_id, '#' || string_agg(CAST(ql AS VARCHAR), ',' ORDER BY chain) || chr(9) || string_agg('1', ',') FROM fq GROUP BY 1",
    "paired_limits": f"WITH {_CHAINS} SELECT * FROM pa WHERE paired_ord <= {MOST_PAIRED}",
    "capped_dedup": f"""WITH RECURSIVE r AS (SELECT msa_id, row_ord, split_part(name, ' ', 1) AS member, seq FROM ({_TURN_ROWS})), f AS (
  SELECT msa_id, -1 AS row_ord, CAST([] AS VARCHAR[]) AS ids, [''] AS seqs, '' AS verdict FROM r WHERE row_ord = 0
  UNION ALL
  SELECT msa_id, row_ord, CASE WHEN verdict = 'kept' THEN list_append(ids, member) ELSE ids END, CASE WHEN verdict = 'kept' THEN list_append(seqs, seq) ELSE seqs END, verdict
  FROM (SELECT r.msa_id, r.row_ord, ids, seqs, member, seq, CASE WHEN len(ids) >= {MAX_DEPTH} - 1 THEN 'capped' WHEN list_contains(ids, member) THEN 'dup_id' WHEN list_contains(seqs, seq) THEN 'dup_seq' ELSE 'kept' END AS verdict FROM f JOIN r ON r.msa_id = f.msa_id AND r.row_ord = f.row_ord + 1)
) SELECT msa_id AS query_id, row_ord, verdict FROM f WHERE row_ord >= 0""",
    "capped_diversity": f"""WITH RECURSIVE {_HITS},
pr AS (SELECT y.msa_id, y.hit_ord, x.hit_ord AS c, x.f AS xf, y.f AS yf, list_filter(range(1, length(y.f) + 1), lambda i: y.f[i] <> '-') AS held FROM fr x JOIN fr y ON x.msa_id = y.msa_id AND x.hit_ord < y.hit_ord),
si AS (SELECT msa_id, hit_ord, list(c) FILTER (WHERE len(held) > 0 AND len(list_filter(held, lambda i: xf[i] = yf[i])) / len(held) >= {LIKE}) AS sim FROM pr GROUP BY 1, 2),
nx AS (SELECT fr.msa_id, fr.hit_ord, coalesce(sim, []) AS sim, row_number() OVER (PARTITION BY fr.msa_id ORDER BY fr.hit_ord) AS k FROM fr LEFT JOIN si ON si.msa_id = fr.msa_id AND si.hit_ord = fr.hit_ord),
fo AS (
  SELECT msa_id, CAST(0 AS BIGINT) AS k, hit_ord, list_filter([hit_ord], lambda i: FALSE) AS took, hit_ord AS twin, FALSE AS chosen FROM nx WHERE k = 1
  UNION ALL
  SELECT msa_id, k, hit_ord, CASE WHEN room AND twin IS NULL THEN list_append(took, hit_ord) ELSE took END, CASE WHEN room THEN twin END, room AND twin IS NULL
  FROM (SELECT nx.msa_id, nx.k, nx.hit_ord, took, len(took) < {MAX_HITS} AS room, list_min(list_intersect(took, sim)) AS twin FROM fo JOIN nx ON nx.msa_id = fo.msa_id AND nx.k = fo.k + 1)
) SELECT fo.msa_id AS query_id, CAST(fo.hit_ord AS INTEGER) AS hit_ord, chosen, acc AS dup_of FROM fo LEFT JOIN fr ON fr.msa_id = fo.msa_id AND fr.hit_ord = fo.twin WHERE k > 0""",
    "donor_by_seeds": f"WITH {CORPUS_SEEDS}, {_PAIRS}, {_TOP} SELECT query, id, 'D' || id AS acc, shared AS score FROM t WHERE id IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, rank) = 1",
    "donor_labels": "SELECT doc_id, trim('D' || doc_id || ' ' || CASE WHEN doc_id % 3 <> 0 THEN coalesce(lang, '') ELSE '' END || ' Tax=' || CASE WHEN doc_id % 4 IN (0, 1) THEN '?' ELSE coalesce(nullif(lang, ''), '?') END || ' TaxID=' || CASE WHEN doc_id % 5 <> 0 THEN coalesce(nullif(regexp_extract(source, '[0-9]+'), ''), '0') ELSE '0' END) AS label FROM documents",
    "file_names": "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_.-]', '_', 'g') AS name FROM pages",
    "row_warnings": f"WITH rows_ AS ({_TURN_ROWS}), i AS ({_IDENT}) SELECT i.msa_id, i.row_ord, 100 * identity < 90 AS low_identity, length(r.seq) / length(q.seq) < 0.8 AS low_coverage FROM i JOIN rows_ r ON r.msa_id = i.msa_id AND r.row_ord = i.row_ord JOIN rows_ q ON q.msa_id = i.msa_id AND q.row_ord = 0 WHERE q.seq <> ''",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
