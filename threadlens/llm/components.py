"""Connected components of links, by alternating large and small stars.

Links stay in DataFrames: each round is two aggregations and joins on vertices,
and only two numbers (count and checksum of the links) reach the driver to see
whether a round changed anything.  Stars shorten paths by halves, so rounds grow
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def labels(links: DataFrame) -> DataFrame:
    """(node, root) for every vertex of links (a, b): root is the least vertex of its component."""
    edge = scratch.durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = _state(edge)
    while before[0]:
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.durable(large, "links")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edge = scratch.durable(small, "links")
        after = _state(edge)
        if after == before:
            break
        before = after
    return edge.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edge.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
