"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two groupings and two joins, checkpointed in the shared folder; the edge table never grows, and the
number of rounds is logarithmic in the length of the longest path. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Hangs the larger (large star) or the smaller (small star) neighbours of each node on its least neighbour."""
    near = edges.select("u", "v")
    if large:
        near = near.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = near.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component."""
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    e, before = cut(e), None
    while True:
        n, total = e.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 16))).first()
        if (n, total) == before or not n:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = (n, total)
        e = cut(_star(_star(e, True), False))
