"""Connected components by alternating star contraction; every round is a few joins and groupings on the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletscope.llm.common import checkpointed


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them. In edges, u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).where("u <> v")


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node in the links (u, v), long each; no node without a link.

    Self-links and repeated links do no harm. The loop ends when a round changes nothing; the only values that reach
    the driver are a count and a checksum per round.
    """
    edges = checkpointed(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        edges = checkpointed(_small(_large(edges).distinct()).distinct())
