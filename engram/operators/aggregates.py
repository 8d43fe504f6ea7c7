"""Counts, breakdowns and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.formulas import freshness_level


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def brain_stats(neurons: DataFrame, synapses: DataFrame, fibers: DataFrame) -> DataFrame:
    """Numbers of nodes, edges and fibers of each brain."""
    parts = [t.groupBy("brain_id").agg(F.count(F.lit(1)).alias("cnt")).withColumn("what", F.lit(n)) for n, t in (("neurons", neurons), ("synapses", synapses), ("fibers", fibers))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("brain_id").agg(*[F.sum(F.when(F.col("what") == w, F.col("cnt")).otherwise(0)).alias(w) for w in ("neurons", "synapses", "fibers")])


def synapse_stats_by_type(synapses: DataFrame) -> DataFrame:
    """By brain and type, and over all types (null), counts, mean weights and reinforcements."""
    return synapses.rollup("brain_id", "type").agg(F.count(F.lit(1)).alias("cnt"), F.avg("weight").alias("avg_weight"), F.sum("reinforced_count").alias("reinforcements")).filter("brain_id is not null")


def co_activation_counts(events: DataFrame, *, since: int | None = None, min_count: int = 1) -> DataFrame:
    if since is not None:
        events = events.filter(F.col("day") >= since)
    return events.groupBy("a", "b").agg(F.count(F.lit(1)).alias("cnt"), F.avg("strength").alias("avg_strength")).filter(F.col("cnt") >= min_count)


def tag_cooccurrence(tags: DataFrame) -> DataFrame:
    """Unordered pairs of tags of one fiber, counted."""
    t = tags.select("fiber_id", "tag").distinct()
    a, b = t.select("fiber_id", F.col("tag").alias("tag_a")), t.select("fiber_id", F.col("tag").alias("tag_b"))
    return a.join(b, "fiber_id").filter("tag_a < tag_b").groupBy("tag_a", "tag_b").agg(F.count(F.lit(1)).alias("cnt"))


def tag_fiber_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.countDistinct("fiber_id").alias("cnt"))


def keyword_idf(keywords: DataFrame, total: DataFrame, *, least: int = 1, most: int = 5) -> DataFrame:
    """keyword, df, idf in 0..1, and how many anchors a keyword may have; total: one row with the number of fibers, n."""
    df = keywords.groupBy("keyword").agg(F.countDistinct("fiber_id").alias("df")).crossJoin(F.broadcast(total))  # one row
    idf = F.log((F.col("n") + 1) / (1 + F.col("df"))) / F.log(F.col("n") + 1)
    limit = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(idf * (most - least + 1)).cast("int")))
    return df.select("keyword", "df", idf.alias("idf"), limit.alias("anchor_limit"))


def tool_stats(events: DataFrame, *, by: Sequence[str], top: int | None = None) -> DataFrame:
    """Uses, success rate (2 places) and mean time of each tool."""
    out = events.groupBy(*by).agg(F.count(F.lit(1)).alias("cnt"), F.round(F.avg(F.col("success").cast("double")), 2).alias("success_rate"), F.avg("duration_ms").alias("avg_ms"))
    return out if top is None else out.orderBy(F.col("cnt").desc(), *by).limit(top)


def graph_density(neurons: DataFrame, synapses: DataFrame) -> DataFrame:
    """Edges for each node, by brain."""
    n, s = count_by(neurons, "brain_id"), count_by(synapses, "brain_id").withColumnRenamed("cnt", "edges")
    return n.join(s, "brain_id", "left").select("brain_id", (F.coalesce("edges", F.lit(0)) / F.col("cnt")).alias("density"))


def freshness_report(items: DataFrame, age: Column, by: str = "brain_id") -> DataFrame:
    """Items of each level of freshness, and their ages."""
    t = items.select(by, age.cast("double").alias("age")).withColumn("level", freshness_level(F.col("age")))
    counts = [F.sum((F.col("level") == v).cast("long")).alias(v) for v in ("fresh", "recent", "aging", "stale", "ancient")]
    return t.groupBy(by).agg(*counts, F.avg("age").alias("avg_age"), F.min("age").alias("min_age"), F.max("age").alias("max_age"))


def fan_effect(tags: DataFrame, *, threshold: int = 15) -> DataFrame:
    """Tags on so many memories that they tell little."""
    return tag_fiber_counts(tags).filter(F.col("cnt") > threshold)


def conditional_counts(df: DataFrame, by: str, **conditions: Column) -> DataFrame:
    """A row for each group with the number of rows that meet each condition."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in conditions.items()])
