"""Readers: FASTA, a3m, depth and cluster tables, query text; adapters of the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.headers import pure_residues
from ..functions.ranges import numbered
from .alignments import fetch_cached  # noqa: F401  one of the readers

MIN_LEN, MAX_LEN = 40, 2000


def letters(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def length_filter(corpus: DataFrame, low: int = MIN_LEN, high: int = MAX_LEN) -> DataFrame:
    return corpus.filter(F.length("seq").between(low, high))


def read_fasta(spark: SparkSession, path: str, accession: str = r"UA=(\S+)") -> DataFrame:
    """(acc, header, seq) of a FASTA file, wrapped or not; records without an accession are dropped. Splits at record
    marks, so large files are read in parallel."""
    records = spark.read.option("lineSep", "\n>").text(path)
    lines = F.split(F.regexp_replace("value", "^>|\r", ""), "\n")
    out = records.select(F.element_at(lines, 1).alias("header"), F.array_join(F.slice(lines, 2, 10**9), "").alias("seq"))
    return out.select(F.regexp_extract("header", accession, 1).alias("acc"), "header", "seq").filter("acc <> ''")


def read_swissprot(spark: SparkSession, path: str, low: int = 30) -> DataFrame:
    return read_fasta(spark, path, r"(?i)^[a-z]{2}\|([^|]+)\|").filter(F.length("seq") >= low)


def read_a3m_folder(spark: SparkSession, path: str) -> DataFrame:
    """(msa_id, text) of the .a3m files of a folder."""
    files = spark.read.option("pathGlobFilter", "*.a3m").text(path, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.a3m$", "").alias("msa_id"), F.col("value").alias("text"))


def read_depths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="acc STRING, depth DOUBLE").filter("depth IS NOT NULL AND NOT isnan(depth)")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").csv(path, schema="rep STRING, entry STRING, flag STRING, taxid STRING")


def parse_a3m(texts: DataFrame) -> DataFrame:
    """(msa_id, row_ord, name, seq) of (msa_id, text): lines before the first > are ignored, body lines are trimmed and
    joined, empty lines skipped. One row-local expression; nothing is shuffled."""
    records = F.slice(F.split(F.concat(F.lit("\n"), "text"), "\n>"), 2, 10**9)
    blanks = F.lit(" \t\r\x0b\x0c")
    rows = texts.select("msa_id", F.posexplode(records).alias("row_ord", "record"))
    lines = F.split("record", "\n")
    return rows.select("msa_id", "row_ord", F.btrim(F.element_at(lines, 1), blanks).alias("name"), F.array_join(F.transform(F.slice(lines, 2, 10**9), lambda x: F.btrim(x, blanks)), "").alias("seq"))


def format_a3m(rows: DataFrame, wrap: int = 0) -> DataFrame:
    """(msa_id, text) of rows (msa_id, row_ord, name, seq)."""
    seq = F.regexp_replace("seq", f"(.{{{wrap}}})(?!$)", "$1\n") if wrap else F.col("seq")
    line = F.struct("row_ord", F.concat(F.lit(">"), "name", F.lit("\n"), seq).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return rows.groupBy("msa_id").agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("text"))


def parse_query_input(queries: DataFrame) -> DataFrame:
    """(query_id, chain_ord, name, seq, valid, error) of (query_id, text): FASTA, or bare sequences with : between chains.
    Unnamed FASTA records are numbered by the chains kept so far, bare chains by their place. ``error`` names a chain
    with other characters than residue letters."""
    t = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    is_fasta = F.startswith(t, F.lit(">"))
    fasta = F.transform(F.split(t, "\n>"), lambda r, i: F.struct(
        F.trim(F.element_at(F.split(F.regexp_replace(r, "^>", ""), "\n"), 1)).alias("name"),
        F.upper(F.regexp_replace(F.array_join(F.slice(F.split(r, "\n"), 2, 10**9), ""), r"[\s*]", "")).alias("seq"), i.alias("i")))
    bare = F.transform(F.split(F.upper(F.regexp_replace(t, r"[\s*]", "")), ":"), lambda p, i: F.struct(F.lit("").alias("name"), p.alias("seq"), i.alias("i")))
    chains = F.filter(F.when(is_fasta, fasta).otherwise(bare), lambda c: c["seq"] != "")
    rows = queries.select("query_id", is_fasta.alias("fasta"), F.posexplode(chains).alias("chain_ord", "c"))
    place = F.when(F.col("fasta"), F.col("chain_ord")).otherwise(F.col("c.i")) + 1
    named = rows.select("query_id", "chain_ord", F.coalesce(F.nullif("c.name", F.lit("")), F.concat(F.lit("chain_"), place)).alias("name"), "c.seq", F.col("c.seq").rlike("^[A-Z]+$").alias("valid"))
    return named.withColumn("error", F.when(~F.col("valid"), F.concat(F.lit('"'), "name", F.lit('" contains non-amino-acid characters'))))


def checked_chains(chains: DataFrame) -> DataFrame:
    """Parsed chains, all of which must be valid: the first that isn't fails the query with its ``error``."""
    return chains.withColumn("seq", F.when(F.col("valid"), F.col("seq")).otherwise(F.raise_error(F.col("error")))).drop("valid", "error")


def concat_shards(shards: list[DataFrame], order: str) -> DataFrame:
    """All rows of the shards, one after the other, with dense ids over all of them."""
    return dense_ids(reduce(DataFrame.unionByName, [s.withColumn("shard", F.lit(i)) for i, s in enumerate(shards)]), "shard", order)


def dense_ids(corpus: DataFrame, shard: str, order: str) -> DataFrame:
    """Dense 0-based ids: by shard, then order inside it; a window sees one range of one shard, and one the shard totals."""
    base = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = corpus.groupBy(F.col(shard).alias("_shard")).agg(F.count("*").alias("n")).select("_shard", F.coalesce(F.sum("n").over(base), F.lit(0)).alias("base"))
    local = numbered(corpus, shard, order, "local")
    return local.join(totals, F.col(shard).eqNullSafe(F.col("_shard"))).withColumn("dense_id", F.col("base") + F.col("local")).drop("_shard", "base", "local")


def sample_rows(corpus: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """The n rows of least seeded hash of ``key``: the same ones however the corpus is dealt out."""
    return corpus.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def draw_rows(corpus: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(draw, key): n draws with replacement from the rows of ``corpus`` in the order of ``key``, a number without ties, by the
    random stream of ``seed``. Tasks draw their own parts of the stream. An empty corpus gives none."""
    placed = numbered(corpus.select(key, F.lit(0).alias("all_rows")), "all_rows", key, "_place")
    rows = placed.count()
    drawn = corpus.sparkSession.range(n if rows else 0).select(F.col("id").alias("draw"), F.floor(uniform(F.col("id"), seed) * rows).alias("_drawn"))
    return drawn.join(placed, F.col("_drawn") == F.col("_place")).select("draw", key)


def packed_scan(corpus: DataFrame, low: int = 50, high: int = 1500, most: int = 0) -> DataFrame:
    """Sequences of low to high residues, all standard; the first ``most`` by id, or all."""
    kept = length_filter(corpus, low, high).filter(pure_residues("seq"))
    return kept.orderBy("id").limit(most) if most else kept


def write_entry_list(ranked: DataFrame, path: str) -> None:
    """One accession a line in the order of rank, in one file: the list is bounded by its budget."""
    ranked.repartition(1).sortWithinPartitions("rank").select("acc").write.text(path)


def _paired_rows(queries: DataFrame, paired: DataFrame, unpaired: DataFrame) -> DataFrame:
    """(msa_id, row_ord, name, seq): row 101 with the chains' own sequences (query_id, chain, seq) one after the other, the
    paired rows in order, then each chain's unpaired ones."""

    def rows(df: DataFrame, chain: Column, order: Column) -> DataFrame:
        return df.select(F.col("query_id").alias("msa_id"), F.struct(chain.cast("int").alias("chain"), order.cast("int").alias("ord")).alias("row_ord"), "name", "seq")

    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain", "seq"))), lambda c: c["seq"]), "")
    first = queries.groupBy("query_id").agg(F.lit("101").alias("name"), joined.alias("seq"))
    return rows(first, F.lit(-2), F.lit(0)).unionByName(rows(paired, F.lit(-1), F.col("paired_ord"))).unionByName(rows(unpaired, F.col("chain"), F.col("row_ord")))


def _paired_lines(headers: DataFrame, queries: DataFrame, paired: DataFrame, unpaired: DataFrame, wrap: int) -> DataFrame:
    """(msa_id, row_ord, value): the header line (query_id, header), then the rows of ``_paired_rows`` as lines."""
    seq = F.regexp_replace("seq", f"(.{{{wrap}}})(?!$)", "$1\n") if wrap else F.col("seq")
    head = headers.select(F.col("query_id").alias("msa_id"), F.struct(F.lit(-3).alias("chain"), F.lit(0).alias("ord")).alias("row_ord"), F.col("header").alias("value"))
    return head.unionByName(_paired_rows(queries, paired, unpaired).select("msa_id", "row_ord", F.concat(F.lit(">"), "name", F.lit("\n"), seq).alias("value")))


#: Rows of a paired alignment that are joined to a piece of its text before the pieces are joined, and bytes of pieces that a task
#: collects, about.
PIECE_ROWS = 512
TASK_BYTES = 16_000_000


def format_paired_a3m(headers: DataFrame, queries: DataFrame, paired: DataFrame, unpaired: DataFrame, wrap: int = 0, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(msa_id, text): the lines of ``_paired_lines``. One text a query, for alignments that fit in one value; ``write_paired_a3m`` is for
    those of any size. Many tasks, by the size of all lines, join lines to pieces and collect these. The one that joins a query's pieces
    allocates the text by its length, and nothing after it copies the text: it's the last step's own result."""
    lines = _paired_lines(headers, queries, paired, unpaired, wrap).select("msa_id", "row_ord.chain", F.floor(F.col("row_ord.ord") / piece_rows).alias("piece"), "row_ord.ord", F.concat("value", F.lit("\n")).alias("value"))

    def joined(order: str) -> Column:
        return F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("chain", order, "value"))), lambda x: x["value"]))

    size = lines.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("n")).first()["n"]
    pieces = lines.repartition(-(-size // TASK_BYTES) or 1, "msa_id", "chain", "piece").groupBy("msa_id", "chain", "piece").agg(joined("ord").alias("value"))
    return pieces.groupBy("msa_id").agg(joined("piece").alias("text"))


def write_paired_a3m(headers: DataFrame, queries: DataFrame, paired: DataFrame, unpaired: DataFrame, path: str, wrap: int = 0) -> None:
    """The lines of ``format_paired_a3m`` under ``path``, a folder ``msa_id=...`` for each query, whose files in the order of their names are
    its alignment. Rows are dealt by ranges of query and place, so a query with most of the rows is written by many tasks, and
    nothing holds a whole alignment. A write that is repeated replaces the folder."""
    lines = _paired_lines(headers, queries, paired, unpaired, wrap)
    lines.repartitionByRange("msa_id", "row_ord").sortWithinPartitions("msa_id", "row_ord").select("msa_id", "value").write.mode("overwrite").partitionBy("msa_id").text(path)


def read_paired_a3m(spark: SparkSession, path: str) -> DataFrame:
    """(msa_id, line) of what ``write_paired_a3m`` wrote."""
    return spark.read.schema("value string, msa_id string").text(path).select("msa_id", F.col("value").alias("line"))


def json_response(chains: DataFrame) -> DataFrame:
    """(query_id, body): the JSON object of chain names and their alignments (query_id, chain_ord, name, text). Of chains with
    one name the last one's alignment counts, at the place of the first."""
    named = chains.groupBy("query_id", "name").agg(F.min("chain_ord").alias("first"), F.max_by("text", "chain_ord").alias("text"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("first", "name", "text"))), lambda e: F.struct(e["name"], e["text"]))
    return named.groupBy("query_id").agg(F.to_json(F.map_from_entries(entries)).alias("body"))
