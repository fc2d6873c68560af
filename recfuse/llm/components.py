"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recfuse.llm.common import dropped, stored


def _least(pairs: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _settled(now: DataFrame) -> bool:
    """Whether every node points to one other node, which points to none."""
    ends = now.select(F.col("u").alias("x"), F.lit(1).alias("from"), F.lit(0).alias("to")).union(now.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("from").alias("f"), F.sum("to").alias("t")).where("f > 1 or (f > 0 and t > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges (a, b): the root is the least node that it reaches.

    Alternates large stars and small stars until every node points to its root, a number of rounds
    that grows with the logarithm of the longest path. Each round's table is written to the shared
    folder, the one before it deleted. Nodes are whole numbers; edges with a null are ignored; an
    empty table gives no rows.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while not _settled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        dropped(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Roots (node, root) after more edges (a, b): components of the edges between the roots, carried back to the nodes.

    Only edges that join different components take part. roots: a stored table.
    """
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = joined.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return old.union(new)
