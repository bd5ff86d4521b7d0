"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that some link has; root is the smallest node of its component.

    Links to itself, repeated links and links either way round are allowed, nulls are dropped, an empty table gives an empty one.
    Each round is written to the shared folder, so a lost executor costs one round at most; rounds grow with the logarithm of
    the longest path. Minima are aggregated before they are shuffled, and only links, never groups, are held by a task.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = common.written(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u, v).distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not now.n or seen == (now.n, now.x):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        seen = (now.n, now.x)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.written(moved.union(least.select("u", "m")).distinct(), "small-star")
