"""Connected components of an edge table by alternating large and small stars.

Each round replaces every node's edges by edges to its smallest neighbour, so components become
stars in a logarithmic number of rounds. Neighbours are never gathered in a row: minima are summed before
the shuffle. The join that hands a node's minimum to its arcs brings a hub's arcs (two numbers each) into one
partition; beyond the adaptive plan's skew threshold it is split, the side of the minima being one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b) after one star step."""
    if large:  # all neighbours; those above the node go to the smallest
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # neighbours below the node
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = arcs.join(least, F.col("u") == F.col("w"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edge table ``a, b``: root is the smallest node of its component."""
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    before = None
    for _ in range(rounds):
        edges = cut(_stars(_stars(edges, True), False), "component-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't stars after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
