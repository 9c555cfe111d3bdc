"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component: the smallest node that links reach) of all nodes that have links.

    ``edges`` has columns a and b. In a large-star step every node's larger neighbours link to its
    smallest neighbour, in a small-star step its smaller neighbours and itself do; the links shrink to
    stars around the smallest nodes. Only least neighbours are gathered, never lists of them, and each
    round is written to the shared folder. The least neighbours are written too: the join with them then has
    two shuffled sides, so a star's centre with very many links is split like any skewed key.
    """
    links = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(most):
        if _is_stars(links):
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        links = stored(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _is_stars(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and none of these has one."""
    seen = links.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(links.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    return not seen.groupBy("n").agg(F.sum("up").alias("ups"), F.count("*").alias("all")).filter("ups > 1 or (ups = 1 and all > 1)").limit(1).count()
