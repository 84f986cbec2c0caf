"""Connected components of a link table, without bringing links to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; nodes without a link are absent.

    ``links`` has long columns ``a`` and ``b``.  Large-star and small-star steps alternate
    until nothing changes: every step moves links towards smaller nodes, the number of links
    never grows, and a component of any size ends as a star around its smallest node in
    logarithmically many rounds.  Each round is stored, so a lost executor repeats one round.
    """
    edges = stored(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    digest = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        # a star table that no longer changes is final
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == digest:
            break
        digest = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # stored, so that a hub's links may be split over tasks in the join
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    return (
        both.join(least.withColumn("m", F.least("a", "m")), "a").where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    smaller = edges.join(least, "a").where(F.col("b") != F.col("m")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    return smaller.union(least.select("a", F.col("m").alias("b"))).where(
        F.col("a") != F.col("b")
    ).distinct()
