"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_stash, stash


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; ``root`` is the smallest node of its component.

    An edge points from its larger end to its smaller one.  Large-star takes the
    smaller end of each edge to the smallest node that it points to; small-star
    takes all that a node points to to the smallest of them.  Both keep what is
    connected, equal edges fall together, and the table shrinks to one edge a node
    other than roots.  Minima are pre-aggregated and joined back, so a node with
    very many edges is never gathered.  Edges are written to the shared folder each
    round: lineage stays short, and a lost executor costs one round.  Only a count
    and a check sum reach the driver.  An empty table has no components; loops and
    repeated edges change nothing, nodes that only have loops are left out.

    Raises RuntimeError if edges still change after ``max_rounds`` rounds (rounds
    grow with the logarithm of the longest path; nothing is dropped).
    """
    now = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        new = stash(_small_star(_large_star(now)), "edges")
        drop_stash(now)
        now, last = new, state
        state = _state(now)
        if state == last:
            ends = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _lowest(edges: DataFrame, node: str) -> DataFrame:
    return edges.groupBy(F.col("a").alias(node)).agg(F.min("b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    return edges.join(_lowest(edges, "b"), "b", "left").select("a", F.coalesce("low", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    met = edges.join(_lowest(edges, "a"), "a")
    return met.select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).distinct()
