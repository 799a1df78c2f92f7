"""Connected components by alternating large-star and small-star steps.

The method is the published one of Kiveris et al. (Connected Components in
MapReduce and Beyond).  Each step is a grouped minimum, which combines before
the shuffle, and an equi-join, which adaptive execution splits when a hub has
many edges; no group is ever gathered.  The number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("a", "b").cast("long")).alias("s")
    ).first()
    return row["n"], row["x"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour above a node to the least of the node's circle."""
    both = edges.select(F.col("b").alias("x"), F.col("a").alias("y")).union(
        edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    )
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return (
        both.filter("y > x").join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the neighbours below a node, and the node, to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return (
        moved.select(F.col("a"), F.col("m").alias("b"))
        .union(moved.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge and is not its own root.

    ``edges`` has two long columns ``a`` and ``b``; loops, nulls and repeats
    are ignored.  A root is the least node of its component; an empty table
    gives an empty one.
    """
    now = saved(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        now = saved(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
