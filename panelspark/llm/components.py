"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import saved


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v, m): links in both directions with the least node m around u, u included."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); the root is the least node reachable.

    Each round is a few joins on the node and is written to the shared folder; the number of
    rounds grows with the logarithm of the longest path. Partial minima leave the executors, so a
    node with very many links is one row per task before the shuffle.
    """
    now = saved(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while True:
        large = _with_least(now).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # large-star keeps every node linked to its least neighbour; small-star links those below it
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        then = saved(small.filter("u != v").distinct(), name)
        # stars only: no node that points to another is pointed at
        deep = then.join(then.select(F.col("u").alias("x")).distinct(), F.col("v") == F.col("x"), "left_semi").limit(1).count()
        many = then.groupBy("u").count().filter("count > 1").limit(1).count() if not deep else 1
        now = then
        if not deep and not many:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
