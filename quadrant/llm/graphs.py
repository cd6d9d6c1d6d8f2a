"""Connected components over a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour. links: (u, v) with u > v."""
    both = links.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(links.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.min("m").alias("least")).select(F.col("n").alias("k"), F.least("n", "least").alias("least"))
    larger = both.where("m > n")
    return larger.join(least, larger.n == least.k).select(F.col("m").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    other = links.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return least.select("u", F.col("least").alias("v")).unionByName(other).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node that a link (a, b) names, with the least node that it reaches.

    Alternating large and small stars (Kiveris and others, 2014): each round only joins and takes minima, so no node's
    neighbours are ever gathered, and rounds grow with the logarithm of the longest path. Repeated links, links both
    ways and links from a node to itself change nothing; such a node alone is its own component. No links: no rows.
    """
    links = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL"), "links")
    state = written(links.where("u > v").distinct(), "stars")
    sign = lambda x: x.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    before = sign(state)
    while before[0]:
        state = written(_large_star(_small_star(state)), "stars")
        after = sign(state)
        if after == before:
            break
        before = after
    # each node below its root has one link, to the root
    leaves = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    return alone.join(leaves, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
