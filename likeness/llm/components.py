"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.session import stored


def _hooked(links: DataFrame, keep) -> DataFrame:
    """Each neighbour that ``keep`` takes, linked to the smallest node around ``u``.

    ``links`` has both directions. The smallest is a partial aggregate and a short table, so a node with very
    many links is split like any skewed join.
    """
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return links.join(least, "u").filter(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _both(links: DataFrame) -> DataFrame:
    there = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return there.unionByName(there.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links ``a``-``b``; the root is the component's smallest node.

    Every round is written out. Rounds grow with the logarithm of the longest path at most twice.
    """
    links = stored(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    mark = None
    while True:
        large = _hooked(_both(links), F.col("v") > F.col("u")).filter(F.col("a") != F.col("b")).distinct()
        # From each node to its smaller neighbours; the node itself is hooked as well.
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hooked = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = hooked.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        links = stored(small.filter(F.col("a") != F.col("b")).distinct(), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(own)
