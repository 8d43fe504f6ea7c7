"""Links, penalties and clusters derived from what memories share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.graph import settled


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b) -> (id, component), the smallest id of each component, by large-star and small-star rounds; minima are partial sums, hubs are never gathered."""

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))

    def down(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, mark = settled(down(edges.select("a", "b"))), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = settled(down(both.join(least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        small = large.join(least(large), "a")
        now = settled(down(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))))
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if new == mark:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        mark = new
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def cross_memory_links(members: DataFrame, fibers: DataFrame, *, entity_cap: int = 50, base: float = 0.3, bonus: float = 0.1, cap: float = 0.7, per_memory: int = 15) -> DataFrame:
    """a, b, shared, weight: anchors of memories that share entities; entities in more than entity_cap memories tell nothing and are left out."""
    rare = members.groupBy("neuron_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= entity_cap).select("neuron_id")
    m = members.join(rare, "neuron_id", "left_semi").join(fibers.select(F.col("id").alias("fiber_id"), "anchor"), "fiber_id").select("neuron_id", "anchor").distinct()
    pairs = m.join(m.withColumnRenamed("anchor", "other"), "neuron_id").filter("anchor < other").groupBy(F.col("anchor").alias("a"), F.col("other").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("shared").desc(), "b"))
    pairs = pairs.withColumn("rank", rank).filter(F.col("rank") <= per_memory)
    return pairs.select("a", "b", "shared", F.least(F.lit(cap), base + bonus * (F.col("shared") - 1)).alias("weight"))


def semantic_links(neurons: DataFrame, *, per_node: int = 20) -> DataFrame:
    """a, b: nodes of one type and content, each with its first followers by id."""
    w = Window.partitionBy("brain_id", "type", F.lower(F.trim("content"))).orderBy("id")
    follow = F.collect_list("id").over(w.rowsBetween(1, per_node))
    return neurons.select(F.col("id").alias("a"), follow.alias("next")).select("a", F.explode("next").alias("b")).withColumn("weight", F.lit(0.4))


def promote_entities(refs: DataFrame, *, threshold: int = 2) -> DataFrame:
    """Entities that enough memories mention."""
    return refs.groupBy("entity").agg(F.countDistinct("fiber_id").alias("mentions"), F.min("fiber_id").alias("first_fiber")).filter(F.col("mentions") >= threshold)


def co_binding(activations: DataFrame, *, min_sets: int = 2) -> DataFrame:
    """query_id, nodes, strength: the nodes that several anchor sets reach together, and their mean share of level."""
    each = activations.groupBy("query_id", "node_id").agg(F.countDistinct("anchor_set").alias("sets"), (F.sum("level") / F.countDistinct("anchor_set")).alias("share")).filter(F.col("sets") >= min_sets)
    return each.groupBy("query_id").agg(F.count(F.lit(1)).alias("nodes"), F.avg("share").alias("strength"))


def shortest_hops(sources: DataFrame, edges: DataFrame, *, max_hops: int = 4) -> DataFrame:
    """source, node_id, hops: breadth-first distances. edges: a, b."""
    edges = settled(edges)
    seen = sources.select(F.col("node_id").alias("source"), "node_id", F.lit(0).alias("hops")).distinct()
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.join(edges, F.col("node_id") == F.col("a")).select("source", F.col("b").alias("node_id")).distinct().join(seen.select("source", "node_id"), ["source", "node_id"], "left_anti")
        frontier = settled(step.withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def goal_proximity(goals: DataFrame, edges: DataFrame, *, hops: int = 3) -> DataFrame:
    """node_id, score: the best of priority / 10 over distance + 1, of all goals (node_id, priority)."""
    d = shortest_hops(goals, edges, max_hops=hops).join(goals.select(F.col("node_id").alias("source"), "priority"), "source")
    return d.groupBy("node_id").agg(F.max(F.col("priority") / 10 / (F.col("hops") + 1)).alias("score"))


def cascade_staleness(seeds: DataFrame, synapses: DataFrame, grounded: DataFrame, *, depth: int = 3, min_weight: float = 0.3) -> DataFrame:
    """node_id, hops of everything that follows from the seeds over LEADS_TO edges; grounded nodes are neither marked nor passed."""
    e = synapses.filter((F.col("type") == "LEADS_TO") & (F.col("weight") >= min_weight)).join(grounded.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    reached = shortest_hops(seeds, e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct(), max_hops=depth)
    return reached.filter("hops > 0").groupBy("node_id").agg(F.min("hops").alias("hops"))


def version_chain(nodes: DataFrame, links: DataFrame, *, most: int = 10) -> DataFrame:
    """node_id, ancestor, n: the chain of older versions behind each node. links: newer, older."""
    steps = nodes.select("node_id", F.col("node_id").alias("ancestor"), F.lit(0).alias("n"))
    every = steps
    for n in range(1, most + 1):
        steps = settled(steps.join(links, F.col("ancestor") == F.col("newer")).select("node_id", F.col("older").alias("ancestor"), F.lit(n).alias("n")).join(every.select("node_id", "ancestor"), ["node_id", "ancestor"], "left_anti").select("node_id", "ancestor", "n"))
        if steps.isEmpty():
            break
        every = every.unionByName(steps)
    return every.filter("n > 0")


def validity_penalty(activations: DataFrame, validity: DataFrame, *, as_of: int, factor: float = 0.1) -> DataFrame:
    """Levels of nodes that are no longer (or not yet) valid, damped."""
    v = validity.select(F.col("id").alias("node_id"), "valid_from", "valid_until")
    outside = F.coalesce((F.col("valid_from") > as_of) | (F.col("valid_until") < as_of), F.coalesce(F.col("valid_from") > as_of, F.lit(False)) | F.coalesce(F.col("valid_until") < as_of, F.lit(False)))
    return activations.join(v, "node_id", "left").select("query_id", "node_id", (F.col("level") * F.when(outside, factor).otherwise(1.0)).alias("level"))


def supersession(activations: DataFrame, newer: DataFrame, *, rounds: int = 5, boost: float = 1.2, damp: float = 0.1) -> DataFrame:
    """Outdated nodes are damped and the newest of their chain is raised. newer: old, new (one successor for each)."""
    last = newer.select("old", "new")
    for _ in range(rounds.bit_length()):
        step = last.join(last.select(F.col("old").alias("new"), F.col("new").alias("next")), "new", "left")
        last = settled(step.select("old", F.coalesce("next", "new").alias("new")))
    newest = last.filter("old <> new").join(activations.select("query_id", F.col("node_id").alias("old")), "old").select("query_id", F.col("new").alias("node_id")).distinct().withColumn("raised", F.lit(1))
    a = activations.join(newer.select(F.col("old").alias("node_id"), F.lit(1).alias("outdated")).distinct(), "node_id", "left").join(newest, ["query_id", "node_id"], "left")
    level = F.when(F.col("outdated") == 1, F.col("level") * damp).when(F.col("raised") == 1, F.least(F.lit(1.0), F.col("level") * boost)).otherwise(F.col("level"))
    return a.select("query_id", "node_id", level.alias("level"))


def trimodal_fusion(channels: Sequence[tuple[str, DataFrame, float]]) -> DataFrame:
    """query_id, fiber_id, score: channels (name, scores, weight) scaled by their range in each query; a channel without a query's scores leaves its weight to the others."""
    w = Window.partitionBy("query_id")
    parts = None
    for name, df, weight in channels:
        low, high = F.min("score").over(w), F.max("score").over(w)
        p = df.select("query_id", "fiber_id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias("s"), F.lit(weight).alias("weight"), F.lit(name).alias("channel"))
        parts = p if parts is None else parts.unionByName(p)
    total = parts.select("query_id", "channel", "weight").distinct().groupBy("query_id").agg(F.sum("weight").alias("total"))
    return parts.groupBy("query_id", "fiber_id").agg(F.sum(F.col("weight") * F.col("s")).alias("raw")).join(total, "query_id").select("query_id", "fiber_id", (F.col("raw") / F.col("total")).alias("score"))


def sufficiency(activations: DataFrame) -> DataFrame:
    """query_id, entropy (bits), focus (share of the best three), top, n: how clear a query's result is."""
    total = F.sum("level").over(Window.partitionBy("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("level").desc(), "node_id"))
    a = activations.filter("level > 0").withColumn("p", F.col("level") / total).withColumn("rank", rank)
    return a.groupBy("query_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum(F.when(F.col("rank") <= 3, F.col("p")).otherwise(0.0)).alias("focus"), F.max("level").alias("top"), F.count(F.lit(1)).alias("n"))


def stabilize(activations: DataFrame, *, rounds: int = 3, noise: float = 0.05, damp: float = 0.85, target: float = 0.5, pull: float = 0.3) -> DataFrame:
    """Rounds of a noise floor, damping and a pull of each query's mean toward a target, at most threefold, clipped to 0..1."""
    w = Window.partitionBy("query_id")
    a = activations.select("query_id", "node_id", "level")
    for _ in range(rounds):
        a = a.filter(F.col("level") >= noise).withColumn("level", F.col("level") * damp)
        mean = F.avg("level").over(w)
        a = a.withColumn("level", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("level") * F.least(F.lit(3.0), 1 + pull * (target / mean - 1)))))
    return a


def cluster_summaries(pairs: DataFrame, items: DataFrame, *, min_size: int = 3, top: int = 3) -> DataFrame:
    """component, size, best: clusters of overlapping fibers (pairs a, b) of some size, and their most salient member."""
    c = connected_components(pairs.select("a", "b"))
    best = F.max_by("id", F.struct("salience", "id"))
    return c.join(items.select("id", "salience"), "id").groupBy("component").agg(F.count(F.lit(1)).alias("size"), best.alias("best"), F.max("salience").alias("salience")).filter(F.col("size") >= min_size)


def alerts(candidates: DataFrame, *, cooldown: int, by: Sequence[str] = ("brain_id", "type")) -> DataFrame:
    """Candidates (by, at) that are let through: one after another in time, each unless an accepted one lies inside the cooldown. The fold runs inside each group's ordered times."""
    times = candidates.groupBy(*by).agg(F.array_sort(F.collect_list("at")).alias("times"))
    first = F.array().cast("array<long>")
    fold = F.aggregate("times", first, lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= cooldown), F.concat(acc, F.array(t))).otherwise(acc))
    return times.select(*by, F.explode(fold).alias("at"))


def depth_prior(outcomes: DataFrame) -> DataFrame:
    """entity, depth, alpha, beta, rate of the depth with the best expected success (Beta prior of one each)."""
    sums = outcomes.groupBy("entity", "depth").agg((1 + F.sum(F.col("success").cast("long"))).alias("alpha"), (1 + F.sum(1 - F.col("success").cast("long"))).alias("beta"))
    rate = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(rate.desc(), "depth"))
    return sums.withColumn("rate", rate).withColumn("rank", rank).filter("rank = 1").drop("rank")

