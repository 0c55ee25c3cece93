"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import materialise


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't its component's smallest, from links (u, v) of longs.

    Each round is a written table, so that a lost executor costs a part of one
    round. Minima are taken map-side first; a node with very many links is
    split by the join. Self-links and repeated links are harmless.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while before != (now := _state(edges)):
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        small = large.join(_least(large), "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
