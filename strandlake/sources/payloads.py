"""JSON answers about entries, as the public prediction API gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the answer's field names
_FIELDS = "array<struct<uniprotSequence: string, uniprotDescription: string, organismScientificName: string, taxId: string>>"


def parse_payloads(bodies: DataFrame) -> DataFrame:
    """(acc, seq, descr, organism, taxid) of (acc, body): a JSON object, or an array of which the first one counts. A missing
    text is empty, and so is a taxon of 0. Entries without a sequence go, and so do empty arrays and bodies that are null or no
    JSON: one missing candidate fails no search."""
    first = bodies.select("acc", F.get(F.from_json("body", _FIELDS), F.lit(0)).alias("e"))  # an object is read as an array of one

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"e.{name}"), F.lit(""))

    taxid = F.when(text("taxId") == "0", "").otherwise(text("taxId"))
    return first.filter(text("uniprotSequence") != "").select("acc", text("uniprotSequence").alias("seq"), text("uniprotDescription").alias("descr"), text("organismScientificName").alias("organism"), taxid.alias("taxid"))
