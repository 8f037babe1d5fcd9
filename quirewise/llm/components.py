"""Connected components of a graph given as a table of edges, with jobs of joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.sources.sinks import stage_table


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest node among them and itself.

    A large star moves larger neighbours only, a small star the node itself and its smaller neighbours. Nodes with a
    third of all edges are summed before the shuffle, and the join back has no step behind it that needs them together.
    """
    if not small:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("node", "m"))
    both = edges.join(least, edges["a"] == least["node"])
    if small:
        moved = both.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    else:
        moved = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)`` but the roots; a root is the smallest node that can be reached.

    Loops, repeated edges and either direction are fine; null ends are left out. Large and small stars take turns until
    an edge set comes out as it went in; chains halve, so the rounds grow with the logarithm of the longest chain. Each
    round is written to the shared folder, so a lost executor costs a part of one round.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = stage_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 16))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        edges = stage_table(_stars(_stars(edges, small=False), small=True), "edges")
