"""Connected components by contraction with random priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


_JOINED = 4  # rounds whose targets are followed in one plan


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b longs): two nodes share a root if a path joins them.

    Each round every node points at whichever of itself and its neighbours has the lowest random priority;
    edges are redrawn between the targets and those within one target vanish. A hub and its leaves are one
    node after two rounds, and of any other shape a constant share of the nodes goes in each. Neighbours are
    reduced before the shuffle, so a hub of any size is one row a task. Loops and repeated edges do no harm;
    no edges, no rows.
    """
    priority = lambda c: F.struct(F.xxhash64(F.col(c)).alias("p"), F.col(c).alias("id"))
    rest = cut(edges.select("a", "b").filter("a <> b").distinct())
    roots = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    turn = 0
    while not rest.isEmpty():
        turn += 1
        both = rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        target = cut(
            both.groupBy("a").agg(F.min(priority("b")).alias("best"))
            .select(F.col("a").alias("node"), F.least(priority("a"), F.col("best"))["id"].alias("to")).filter("node <> to")
        )
        moved = target.select(F.col("node").alias("root"), "to")
        roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        if turn % _JOINED == 0:
            roots = cut(roots)
        ends = rest.join(target.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a", "left")
        ends = ends.join(target.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b", "left")
        ends = ends.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        rest = cut(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return roots
