"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours, and in small stars itself, move to its smallest neighbour.

    A node with very many neighbours is not gathered: its smallest neighbour is a partial aggregate, joined back.
    """
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        out = both.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of links (a, b: long). The rounds grow with the logarithm of the longest chain."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        # the driver sees a count and a hash
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        after = materialize(_star(_star(edges, True), False), "edges")
        discard(edges)
        edges, before = after, state
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
