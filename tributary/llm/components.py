"""Connected components of a links table by alternating star contraction.

Every round is one minimum per node (combined before its shuffle) and one equi-join, so a hub with most
of the links is neither collected nor handled alone: its rows are ordinary join rows. A round at least
shrinks every path by a constant factor, and its rows never exceed the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import free, let_go, settled


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("a", "b") % 1_000_003))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); root is the smallest node reachable.

    Null ends and links of a node with itself are ignored; no links give no rows. Repeated links count once.
    """
    links = settled(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before, mark = None, _mark(links)
    while mark != before and mark[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        made = settled(moved.union(small.select("a", F.col("m").alias("b"))).distinct())
        free(links)
        links = made
        before, mark = mark, _mark(links)
    let_go(links)
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
