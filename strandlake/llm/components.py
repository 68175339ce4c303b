"""Connected components over distributed edges, without large groups and without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: long columns a and b, both non-null. Returns (node, root) for every node of a link; root is the least
    node of its component. No links give no rows.

    Each round lets every node point to its least neighbour if that is less, follows the pointers to their ends by
    doubling, and joins the nodes of each tree to one. At least half of the nodes that have links go in a round. All
    steps are joins and pre-aggregated minima; each is written to the shared folder, so no lost executor costs lineage.
    """
    both = links.select("a", "b").filter("a <> b")
    parts = 1 + links.count() // 1_000_000  # few links, few files

    def stored(df: DataFrame) -> DataFrame:
        return materialise(df.coalesce(parts))

    edges = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    mapping = None
    while True:
        up = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
        while True:
            end = up.select(F.col("node").alias("root"), F.col("root").alias("end"))
            further = stored(up.join(end, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")))
            up = further.select("node", "root")
            if not further.filter("moved").limit(1).count():
                break
        if mapping is None:
            mapping = up
        else:
            onward = up.select(F.col("node").alias("root"), F.col("root").alias("end"))
            mapping = stored(mapping.join(onward, "root", "left").select("node", F.coalesce("end", "root").alias("root")))
        to_a, to_b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(edges.join(to_a, "a").join(to_b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        if not edges.limit(1).count():
            return mapping
