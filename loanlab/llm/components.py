"""Connected components by alternating large-star and small-star steps.

Edges are rows (u, v) of any orderable type. Each half step takes every node's
smallest neighbour (an aggregation that combines before the shuffle) and joins
it back to the edges; the minima are written to the shared checkpoint folder
first, so that both sides of the join are plain exchanges and a hub with a
third of all edges is split by the skewed-join rule. Only an edge count and a
checksum reach the driver. The number of rounds is logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


PER_TASK = 50_000  # edges; small graphs need no wide stages


def _narrow(df: DataFrame, n: int) -> DataFrame:
    return df.coalesce(max(6, -(-n // PER_TASK)))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's minimum."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stored(_narrow(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), n),
                 "large-star")
    return (both.where("v > u").join(low, "u").where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to their minimum."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = stored(_narrow(down.groupBy("u").agg(F.min("v").alias("m")), n), "small-star")
    moved = (down.join(low, "u").where(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node
    of the component. Self loops and repeated edges are allowed."""
    edges = edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stored(edges.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        n = state[0]
        # the shuffled star of a round is read twice by the next half round
        star = stored(_narrow(_large_star(edges, n), n), "star")
        edges = stored(_narrow(_small_star(star, n), n), "edges")
        new = _state(edges)
        if new == state:
            break
        state = new
    # at the end every edge points from a node to its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
