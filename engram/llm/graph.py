"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import staged


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b) -> (id, component): for every end of a link the smallest id that links reach.

    Minima are partial aggregates and links are joined back to them, so no node's links meet in one group; every round
    is written to the shared folder, and only a count and a checksum come to the driver.
    """
    least = lambda e: e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    ordered = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = staged(ordered(links.select("a", "b").na.drop()), "links"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(ordered(large), "large")
        small = large.join(least(large), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = staged(ordered(small), "small")
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
