"""Connected components by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import pinned


def _lowest(edges: DataFrame, node: str, neighbour: str) -> DataFrame:
    """The smallest of each node and its neighbours; folded on the map side, so hubs are no hot groups."""
    return edges.groupBy(F.col(node).alias("node")).agg(F.least(F.min(neighbour), F.col("node")).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the smallest of that node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = _lowest(both, "a", "b")
    moved = both.where("b > a").join(lowest, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, go to the smallest of them (edges: a > b)."""
    lowest = _lowest(edges, "a", "b")
    moved = edges.join(lowest, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = lowest.select(F.col("node").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b) to another; the component is its smallest node.

    Each round works on stored edges, written to the shared checkpoint folder. Self-loops and nulls
    are passed over; repeated edges count once. Rounds grow with the logarithm of the longest path.
    """
    now = pinned(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(now)
    while before[0]:
        now = pinned(_small_star(_large_star(now)))
        after = print_of(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
