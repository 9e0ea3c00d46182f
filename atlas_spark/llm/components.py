"""Connected components of an edge table by alternating star contractions, every round as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only and no larger ones: each component is then a star around its least node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.filter("down > 1 or down = 1 and up = 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``; the label is the least node reachable.

    NULL ends are dropped, loops and repeated edges do no harm.  The number of rounds grows with the
    logarithm of the longest chain; it raises where MAX_ROUNDS are not enough rather than end early.
    Each round is checkpointed, so a lost executor does not replay the rounds before it.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).filter("node is not null").distinct()
    now = cut_lineage(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        if _is_forest_of_stars(now):
            break
        now = cut_lineage(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    label = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
