"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import checkpointed


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest node of its component for every node of ``links(a, b)`` that is not itself the smallest.

    Returns ``(node, component)``; nodes missing from it are alone or the smallest of theirs. Links are
    undirected, repeated links and self links change nothing, null ends are ignored. Every star step takes
    the smallest neighbour of each node (combined map-side) and points all its larger neighbours there;
    the steps alternate until the table stays the same, and each is checkpointed in the shared folder.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = checkpointed(links.where("a <> b").distinct())
    state = None
    while True:
        links = checkpointed(_small(_large(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
