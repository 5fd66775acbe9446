"""Connected components of an edge table, as Spark jobs.

Alternating large-star and small-star steps (Kiveris et al., 2014) make every
component a star around its smallest id in about log(n) rounds.  Each round is
two aggregations and two joins whose right sides have one row per node.  While
these are small they are broadcast, so that a node with very many neighbours stays
where its edges are; beyond, it makes a skewed left side, which adaptive execution
splits.  Rounds end as soon as all edges form stars.  Nothing but two numbers per round
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm.tables import BROADCAST, Scratch

#: Bytes of a node with its least neighbour.
NODE_BYTES = 24


def _star(edges: DataFrame, few: bool) -> DataFrame:
    """One large-star and one small-star step on (u, v) with u > v; few: one row per node may be broadcast."""
    mark = F.broadcast if few else lambda x: x
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(mark(least), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    lower = large.join(mark(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node with an edge, root being the component's smallest id.

    edges: two long columns a and b; loops, repeats and both directions are fine.
    Nodes without edges do not appear; the caller takes them as their own roots.
    """
    stars = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("root")))
        ends = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("root").alias("root"))
        number, unsettled = ends.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("root") > 0)))).first()
        if not unsettled:
            break  # every node has one lower neighbour, which has none
        before = scratch.paths[-1]
        stars = scratch.save(_star(stars, 2 * number * NODE_BYTES <= BROADCAST), "stars")
        scratch.drop([before])
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
