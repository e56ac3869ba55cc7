"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) in, (node, root) out for all nodes but the roots, which are the least of their component.

    Each round is a large star (every larger neighbour of a node links to the
    least) and a small star (every smaller one does); a written table ends it.
    The number of rounds is logarithmic; no node's neighbours are collected.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _least(large).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = materialize(small, "edges")
        state = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
        discard(now)
        now = new
        if state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state


def _least(edges: DataFrame) -> DataFrame:
    """The edges with the least of a and its neighbours as m: aggregated before the shuffle, so a node with many neighbours isn't one task's work."""
    return edges.join(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "a")
