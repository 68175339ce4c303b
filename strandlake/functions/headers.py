"""Scalar functions on headers and alignment rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def taxid_of(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, r"(?i)TaxID[=:](\d+)", 1), F.lit(""))


def organism_of(header: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(header, r"(?i)Tax=([^=]*?)\s+TaxID=", 1)), F.lit(""))


def member_id_of(header: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(header, r"^(\S+)", 1), F.lit("")), header)


def donor_label(acc: Column, desc: Column, organism: Column, taxid: Column) -> Column:
    def known(c: Column, default: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))

    return F.trim(F.concat(acc, F.lit(" "), F.coalesce(desc, F.lit("")), F.lit(" Tax="), known(organism, "?"), F.lit(" TaxID="), known(taxid, "0")))


def match_states(row: Column) -> Column:
    return F.length(F.regexp_replace(row, "[a-z]", ""))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), "u1") if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def row_identity(query: str, row: str) -> float:
    columns = points(row)
    columns = columns[(columns < 97) | (columns > 122)]
    n = min(len(columns), len(own := points(query)))
    held = columns[:n] != 45
    count = int(held.sum())
    return int(((columns[:n] == own[:n]) & held).sum()) / count if count else 0.0


@F.pandas_udf(DoubleType())
def _identities(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for queries, rows in pairs:
        yield pd.Series([None if q is None or r is None else row_identity(q, r) for q, r in zip(queries, rows, strict=True)], dtype="float64")


def identity_to_query(query: Column, row: Column) -> Column:
    """Share of a row's residues in query columns that equal the query's. By NumPy, as rows can be whole texts, of which
    higher-order functions would be interpreted a letter at a time."""
    return _identities(query, row)


def paired_header(lengths: Column) -> Column:
    return F.concat(F.lit("#"), F.array_join(F.transform(lengths, lambda n: n.cast("string")), ","), F.lit("\t"), F.array_join(F.transform(lengths, lambda n: F.lit("1")), ","))


def pure_residues(seq) -> Column:
    """Whether a sequence holds standard residues only, and some."""
    return F.rlike(seq, F.lit("^[ACDEFGHIKLMNPQRSTVWY]+$"))


def file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_.-]", "_")


def hit_warnings(identity: Column, coverage: Column) -> list[Column]:
    """Flags of a hit: identity below 90 %, coverage below 0.8."""
    return [(identity < 90).alias("low_identity"), (coverage < 0.8).alias("low_coverage")]


def mutated(seq: str, key: str, rate: float, seed: int = 1) -> Column:
    """A sequence with each standard residue replaced by another one with chance ``rate``, by a hash of key, place and
    seed. Other letters stay."""
    h = f"((pmod({key}, 65536) * 40503 + i * 2654435761L + {seed * 97}) % 4294967296L)"
    mixed = f"((({h} ^ shiftright({h}, 15)) * 1103515245L) & 4294967295L)"
    letters = "ACDEFGHIKLMNPQRSTVWY"
    other = f"substr('{letters}', cast((instr('{letters}', c) + shiftright({mixed}, 16) % 19) % 20 + 1 as int), 1)"
    return F.expr(f"array_join(transform(split({seq}, ''), (c, i) -> CASE WHEN instr('{letters}', c) > 0 AND {mixed} % 10000 < {round(rate * 10000)} THEN {other} ELSE c END), '')")


def register(spark: SparkSession) -> None:
    """The functions that SQL queries can call by name: those below; seeds(seq) and sw_align(query, target), also with options as
    seeds_with(seq, k, target) and sw_align_with(query, target, gap_open, gap_extend); sw_score(query, target); and the table function
    parse_a3m(text), for lateral joins."""
    from .align import align_udf, align_with_udf, score_udf
    from .seeding import seeds_udf, seeds_with_udf

    spark.udf.register("seeds", seeds_udf())
    spark.udf.register("seeds_with", seeds_with_udf)
    spark.udf.register("sw_align", align_udf)
    spark.udf.register("sw_align_with", align_with_udf)
    spark.udf.register("sw_score", score_udf)
    blanks = r"' \t\r\u000b\u000c'"
    spark.sql(rf"""
CREATE OR REPLACE TEMPORARY FUNCTION parse_a3m(text STRING) RETURNS TABLE (row_ord INT, name STRING, seq STRING) RETURN
SELECT pos AS row_ord, btrim(element_at(split(col, '\n'), 1), {blanks}) AS name, array_join(transform(slice(split(col, '\n'), 2, 1000000000), x -> btrim(x, {blanks})), '') AS seq
FROM (SELECT posexplode(slice(split(concat('\n', text), '\n>'), 2, 1000000000)))""")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION organism_of(h STRING) RETURNS STRING RETURN nullif(trim(regexp_extract(h, '(?i)Tax=([^=]*?)\\s+TaxID=', 1)), '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION paired_header(n ARRAY<INT>) RETURNS STRING RETURN concat('#', array_join(n, ','), '\t', array_join(array_repeat('1', size(n)), ','))")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION taxid_of(h STRING) RETURNS STRING RETURN nullif(regexp_extract(h, '(?i)TaxID[=:](\\d+)', 1), '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION match_states(s STRING) RETURNS INT RETURN length(regexp_replace(s, '[a-z]', ''))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION member_id_of(h STRING) RETURNS STRING RETURN coalesce(nullif(regexp_extract(h, '^(\\\\S+)', 1), ''), h)")
