"""Connected components of a graph held as rows, by alternating star contractions; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least node that it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("root"))
    moved = edges.join(least, "a").select(F.explode(F.array(F.struct("b", "root"), F.struct(F.col("a").alias("b"), "root"))).alias("e"))
    return moved.select(F.col("e.b").alias("a"), F.col("e.root").alias("b")).where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b), either way round, to (node, root): root is the least node of the component. Nodes without an edge have no row.

    Each round is written to the shared checkpoint folder. It ends when a round changes no edge, after a number of rounds that
    grows with the logarithm of the longest path.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen or state["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen, now = state, cut_lineage(_small_star(_large_star(now)))
