"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import find_hot_keys, salted_join
from ..session import shuffle_partitions
from .common import written


HUB = 100_000        # edges of a node that one task may well hold


def _with_least(edges: DataFrame, node: str, least: DataFrame, n: int) -> DataFrame:
    """Every one of ``n`` edges with ``m``, the smallest node next to its
    ``node`` (NULL if ``least`` has none); a node with more than ``HUB`` edges
    and than an even share of them is spread over tasks."""
    share = max(HUB, n // shuffle_partitions(edges.sparkSession))
    hubs = find_hot_keys(edges.select(node), node, share) if n > share else None
    return salted_join(edges, least.withColumnRenamed("of", node), node, hubs, "left")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node
    of ``edges`` (long columns ``a``, ``b``).

    Each round hangs the larger neighbours of a node under its smallest one
    (large star), then the smaller ones (small star); rounds grow with the
    logarithm of the longest path.  A node's smallest neighbour comes from a
    pre-aggregated groupBy and is joined back with the edges of a node that
    has very many spread over tasks.  Every round is written to the shared
    folder, so a lost executor costs a task and no round.
    """
    now = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                  .filter("hi != lo").distinct(), "edges")
    while True:
        least = now.groupBy(F.col("hi").alias("of")).agg(F.min("lo").alias("m"))
        # an edge's lower end passes the upper one on to its own smallest neighbour, if it has a smaller one
        large = written(_with_least(now, "lo", least, now.count()).select("hi", F.coalesce("m", "lo").alias("lo")).distinct(), "edges")
        low = large.groupBy(F.col("hi").alias("of")).agg(F.min("lo").alias("m"))
        small = (_with_least(large, "hi", low, large.count()).filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionByName(low.select(F.col("of").alias("hi"), F.col("m").alias("lo"))))
        after = written(small.distinct(), "edges")
        stats = after.agg(F.count("*").alias("n"), F.countDistinct("hi").alias("nodes")).first()
        roots = after.join(after.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").limit(1).count()
        if stats["n"] == stats["nodes"] and not roots:
            top = after.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(top)
        now = after
