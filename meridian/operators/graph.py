"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.operators.frames import cut, kept, written


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node that a link (a, b) names.

    Each round contracts trees: every node points to the least of its neighbours and itself by a
    hash that differs from round to round, pointers are doubled until none moves, and the links
    are taken over to the tops. With such hashes the pointers make short trees whatever the
    names, a path in ascending order included, and every node that still has a link loses
    itself or a neighbour, so rounds, and doublings in a round, grow with the logarithm of the
    number of nodes. The rounds' tables are removed at the end.
    """
    with written(links.sparkSession):
        return kept(_rooted(links))


def _rooted(links: DataFrame) -> DataFrame:
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    tops, n = None, 0
    while not links.isEmpty():
        step = _tops(links, n)
        if tops is None:
            tops = step
        else:
            moved = tops.join(step.select(F.col("node").alias("top"), F.col("top").alias("higher")), "top", "left")
            tops = cut(moved.select("node", F.coalesce("higher", "top").alias("top")))
        ends = links
        for end in ("a", "b"):
            ends = ends.join(step.select(F.col("node").alias(end), F.col("top").alias(f"{end}_top")), end)
        links = cut(ends.select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).where("a <> b").distinct())
        n += 1
    if tops is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = tops.groupBy("top").agg(F.min("node").alias("root"))  # summed up before it is shuffled
    return tops.join(least, "top").select("node", "root")


def _place(node: Column, n: int) -> Column:
    """What nodes are compared by in a round: a hash, and the node itself where hashes are equal."""
    return F.struct(F.xxhash64(node, F.lit(n)).alias("h"), node.alias("node"))


def _tops(links: DataFrame, n: int) -> DataFrame:
    """node, top: where each node's pointers end. Pointers go to lesser hashes, so they have no cycle."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    to = both.groupBy("a").agg(F.min(_place(F.col("b"), n)).alias("least"))
    own = _place(F.col("a"), n)
    at = cut(to.select(F.col("a").alias("node"), F.least(own, F.col("least"))["node"].alias("top")))
    while True:
        jump = at.join(at.select(F.col("node").alias("top"), F.col("top").alias("next")), "top")
        jump = cut(jump.select("node", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved")))
        at = jump.select("node", "top")
        if jump.where("moved").isEmpty():
            return at
