"""What a session's past makes likely: nodes that are warm before a query is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.anchors import content_hits

#: Levels of the sources, and what they need.
TOPIC, HABIT, TOGETHER, FADE = 0.15, 0.12, 0.10, 0.7
TOPIC_LEAST, HABIT_LEAST, STRENGTH_LEAST, COUNT_LEAST, LEVEL_LEAST = 0.5, 0.6, 0.5, 3, 0.01
TOPIC_NODES, HABIT_TOPICS, HABIT_NODES, TOGETHER_PAIRS, CACHE_NODES = 30, 3, 10, 20, 200


def activation_cache(history: DataFrame, *, fade: float = FADE, most: int = CACHE_NODES) -> DataFrame:
    """session_id, node_id, level: what a session reached, faded by each query since, the highest level of a node, of the `most` strongest.

    history: session_id, turn (0, 1, ...), node_id, level (0 to 1). The last turn is the one before the query."""
    last = history.groupBy("session_id").agg(F.max("turn").alias("last"))
    faded = history.join(last, "session_id").select("session_id", "node_id", (F.col("level") * F.pow(F.lit(fade), F.col("last") - F.col("turn"))).alias("level"))
    best = faded.groupBy("session_id", "node_id").agg(F.max("level").alias("level")).filter(F.col("level") >= LEVEL_LEAST)
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.round("level", 9).desc(), "node_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def priming_boosts(sessions: DataFrame, topics: DataFrame, nodes: DataFrame, habits: DataFrame, together: DataFrame, recent: DataFrame, cache: DataFrame) -> DataFrame:
    """session_id, node_id, boost, sources: the highest boost of a node by any source, and how many there are.

    sessions: session_id, queries, aggressiveness; topics: session_id, topic, ema; nodes: node_id, content, abstract (boolean); habits: topic,
    next_topic, weight; together: a, b, count, strength; recent: session_id, node_id (of the last result); cache: as activation_cache.
    Topics count from a session's second query, habits from its third. Nodes of abstractions gain a quarter more.
    """
    hot = topics.filter(F.col("ema") >= TOPIC_LEAST).join(sessions.filter("queries >= 2").select("session_id"), "session_id", "left_semi")
    share = F.greatest(F.lit(3), F.floor(F.lit(TOPIC_NODES) / F.count(F.lit(1)).over(Window.partitionBy("session_id"))))
    hot = hot.withColumn("share", share)
    order = Window.partitionBy("session_id").orderBy(F.round("ema", 9).desc(), "topic")
    top = topics.join(sessions.filter("queries >= 3").select("session_id"), "session_id", "left_semi").withColumn("nth", F.row_number().over(order)).filter("nth <= 5")
    next_ = top.join(habits.filter(F.col("weight") >= HABIT_LEAST), "topic")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("nth", F.round("weight", 9).desc(), "next_topic"))
    next_ = next_.withColumn("place", place).filter(F.col("place") <= HABIT_TOPICS)
    warm = topics.filter(F.col("ema") >= TOPIC_LEAST).select("session_id", F.col("topic").alias("next_topic"))
    next_ = next_.join(warm, ["session_id", "next_topic"], "left_anti")
    hits = content_hits(nodes.select("node_id", "content"), hot.select(F.col("topic").alias("term")).union(next_.select("next_topic")), most=TOPIC_NODES)
    by_topic = hot.join(hits, F.col("topic") == F.col("term")).filter(F.col("place") <= F.col("share")).select("session_id", "node_id", (TOPIC * F.least("ema", F.lit(1.0))).alias("boost"))
    by_habit = next_.drop("place").join(hits, F.col("next_topic") == F.col("term")).filter(F.col("place") <= HABIT_NODES).select("session_id", "node_id", (HABIT * F.col("weight")).alias("boost"))
    raised = lambda t: t.join(nodes.filter("abstract").select("node_id", F.lit(1.25).alias("more")), "node_id", "left").select("session_id", "node_id", (F.col("boost") * F.coalesce("more", F.lit(1.0))).alias("boost"))
    pairs = together.filter((F.col("count") >= COUNT_LEAST) & (F.col("strength") >= STRENGTH_LEAST))
    both = pairs.select(F.col("a").alias("node_id"), F.col("b").alias("target"), "strength").unionByName(pairs.select(F.col("b").alias("node_id"), F.col("a").alias("target"), "strength"))
    near = recent.distinct().join(both, "node_id").join(recent.select("session_id", F.col("node_id").alias("target")).distinct(), ["session_id", "target"], "left_anti")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.round("strength", 9).desc(), "target", "node_id"))
    near = near.withColumn("place", place).filter(F.col("place") <= TOGETHER_PAIRS).select("session_id", F.col("target").alias("node_id"), (TOGETHER * F.least("strength", F.lit(1.0))).alias("boost"))
    every = None
    for source, t in (("cache", cache.select("session_id", "node_id", F.col("level").alias("boost"))), ("topic", raised(by_topic)), ("habit", raised(by_habit)), ("together", near)):
        t = t.withColumn("source", F.lit(source))
        every = t if every is None else every.unionByName(t)
    every = every.join(sessions.select("session_id", "aggressiveness"), "session_id").withColumn("boost", F.col("boost") * F.coalesce("aggressiveness", F.lit(1.0)))
    every = every.filter((F.col("source") != "cache") | (F.col("boost") >= LEVEL_LEAST))
    return every.groupBy("session_id", "node_id").agg(F.max("boost").alias("boost"), F.count_distinct("source").alias("sources"))


def primed(anchors: DataFrame, boosts: DataFrame) -> DataFrame:
    """Anchors (session_id, node_id, level) with what primes them added, up to 1; nodes that are only primed join them."""
    both = anchors.select("session_id", "node_id", "level").unionByName(boosts.select("session_id", "node_id", F.col("boost").alias("level")))
    return both.groupBy("session_id", "node_id").agg(F.least(F.lit(1.0), F.sum("level")).alias("level"))
