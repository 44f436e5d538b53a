"""Connected components of a large set of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peagelens.session import settle


def _stars(links: DataFrame) -> DataFrame:
    """One round: link larger neighbours, then smaller ones, to each node's smallest."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    hub = F.least("a", "m")
    large = (
        both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), hub.alias("b")).distinct()
    )
    lows = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(lows, "a")
    return (
        joined.where(F.col("b") != F.col("m"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(lows.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node in a link (a, b); root is the component's smallest node.

    The links stay distributed and are written to the shared folder each round, so a
    lost executor repeats one round at most. Rounds grow with the logarithm of the
    longest chain. A run that does not settle raises an error instead of stopping early.
    """
    now = settle(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct(),
        "links",
    )
    state = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        state, now = mark, settle(_stars(now), "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
