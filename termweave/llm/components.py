"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step is one partial-aggregated minimum and one join; the edges go to the shared folder after each round, and only
two numbers, a count and a checksum, come to the driver. The number of rounds is logarithmic in the longest path. The
centre of a large star is one key of many rows: beyond MANY edges it meets its minimum by a broadcast of hot keys' minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import _shared


#: Edges that one task could hold, were they all of one star.
MANY = 1_000_000


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _met(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    return _shared.attach(edges, _shared.stable(least), "u") if many else edges.join(least, "u")


def _large(edges: DataFrame, many: bool) -> DataFrame:
    """Every neighbour above a node is tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return _met(both, least, many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, many: bool) -> DataFrame:
    """Every neighbour below a node, and the node itself, is tied to the least of them. Here u > v in every edge."""
    least = _least(edges)
    moved = _met(edges, least, many).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, many: int = MANY) -> DataFrame:
    """Edges (u, v) -> (u, v): each node that is not the least of its component, with the least. Nulls are no nodes."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, before = _shared.stable(edges), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges
        before = state
        edges = _shared.stable(_small(_shared.stable(_large(edges, state[0] > many)), state[0] > many))
