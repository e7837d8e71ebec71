"""Connected components of links between 64-bit numbers, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulewatch.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of links ``a, b``: the smallest number reachable.

    Alternates large-star and small-star rounds until the links are stars already.  A round is
    grouping and joining by node: minima combine before the shuffle, and the join of a hub with
    many links has a unique side, so Spark can split it.  Rounds are stored: lineage stays short.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    while True:
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        links = stored(_small_star(stored(_large_star(links), "components")), "components")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _large_star(links: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node with the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours with the least of them; ``a`` is the larger end."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
