"""Sequences, moving averages and rows kept for each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(events: DataFrame, *, window_us: int) -> DataFrame:
    """session_id, a, b, gap (seconds): an action and the next of its session, at most a window later."""
    w = Window.partitionBy("session_id").orderBy("at_us", "id")
    e = events.select("session_id", F.col("action").alias("a"), F.lead("action").over(w).alias("b"), ((F.lead("at_us").over(w) - F.col("at_us")) / 1e6).alias("gap"))
    return e.filter(F.col("b").isNotNull() & (F.col("gap") <= window_us / 1e6))


def sequential_pairs(events: DataFrame, *, window_us: int) -> DataFrame:
    return transitions(events, window_us=window_us).groupBy("a", "b").agg(F.count(F.lit(1)).alias("cnt"), F.avg("gap").alias("avg_gap"))


def habit_candidates(pairs: DataFrame, sessions: Column, *, min_frequency: int) -> DataFrame:
    """Frequent pairs, and triples A, B, C (C is not A) of two of them: frequency the smaller, duration the sum, confidence for each session."""
    p = pairs.filter(F.col("cnt") >= min_frequency)
    two = p.select(F.concat_ws(">", "a", "b").alias("steps"), F.col("cnt").alias("frequency"), F.col("avg_gap").alias("duration"))
    q = p.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("cnt").alias("cnt2"), F.col("avg_gap").alias("gap2"))
    three = p.join(q, "b").filter("c <> a").select(F.concat_ws(">", "a", "b", "c").alias("steps"), F.least("cnt", "cnt2").alias("frequency"), (F.col("avg_gap") + F.col("gap2")).alias("duration"))
    return two.unionByName(three).withColumn("confidence", F.col("frequency") / sessions)


def ema(rows: DataFrame, *, by: str, order: Sequence[Column], value: Column, window: int) -> DataFrame:
    """The exponential moving average of each group's newest `window` values, begun with the oldest, in closed form."""
    newest = F.row_number().over(Window.partitionBy(by).orderBy(*[c.desc() for c in order])) - 1
    kept = rows.select(by, value.cast("double").alias("v"), newest.alias("k")).filter(F.col("k") < window)
    alpha = 2.0 / (window + 1)
    last = F.max("k").over(Window.partitionBy(by))
    weight = F.when(F.col("k") == last, F.pow(F.lit(1 - alpha), F.col("k"))).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("k")))
    return kept.withColumn("w", weight).groupBy(by).agg(F.sum(F.col("w") * F.col("v")).alias("ema"), F.count(F.lit(1)).alias("n"))


def per_group_topk(df: DataFrame, *, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def latest_per_key(df: DataFrame, *, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return per_group_topk(df, keys=keys, order=[c.desc() for c in order], k=1).drop("rank")


def sessionize(events: DataFrame, *, gap_us: int) -> DataFrame:
    """session_id, part, begin, end, events: a session falls apart where nothing happens for longer than the gap."""
    w = Window.partitionBy("session_id").orderBy("at_us", "id")
    new = F.coalesce((F.col("at_us") - F.lag("at_us").over(w)) > gap_us, F.lit(True)).cast("long")
    parts = events.withColumn("new", new).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("session_id", "part").agg(F.min("at_us").alias("begin"), F.max("at_us").alias("end"), F.count(F.lit(1)).alias("events"))
