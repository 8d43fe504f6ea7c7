"""Activation, paths and shape of the memory graph. Loops run one bounded job a round and cut lineage with checkpoint()."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What activation gains or loses over an edge of a role.
ROLE_FACTOR = {"REINFORCEMENT": 1.3, "SUPERSESSION": 1.2, "SEQUENTIAL": 1.1, "STRUCTURAL": 1.0, "LATERAL": 0.9, "PASSIVE": 0.85, "WEAKENING": 0.0}
#: Edge types of each role; all others are structural.
ROLES = {
    "SUPERSESSION": ("RESOLVED_BY", "SUPERSEDES", "EVOLVES_FROM", "FALSIFIED_BY"),
    "REINFORCEMENT": ("EVIDENCE_FOR", "VERIFIED_BY", "EFFECTIVE_FOR"),
    "WEAKENING": ("EVIDENCE_AGAINST", "CONTRADICTS", "PREVENTS"),
    "SEQUENTIAL": ("BEFORE", "AFTER", "LEADS_TO", "CALLS", "ENABLES", "CAUSED_BY"),
    "LATERAL": ("CO_OCCURS", "RELATED_TO", "SIMILAR_TO", "USED_WITH"),
    "PASSIVE": ("STORED_BY", "VERIFIED_AT", "APPROVED_BY", "ALIAS", "FELT", "EVOKES", "HAPPENED_AT", "DURING", "MEASURED_AT"),
}


def settled(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared checkpoint folder, so that a loop's lineage does not grow."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="engram-"))
    return df.checkpoint(eager=True)


def role_factor() -> Column:
    factor = None
    for role, types in ROLES.items():
        test = F.col("type").isin(*types)
        factor = F.when(test, ROLE_FACTOR[role]) if factor is None else factor.when(test, ROLE_FACTOR[role])
    return factor.otherwise(ROLE_FACTOR["STRUCTURAL"])


def walkable(synapses: DataFrame, states: DataFrame | None = None, *, min_weight: float = 0.1) -> DataFrame:
    """source, target, factor of edges that activation follows: weight, role and how often the target is used."""
    e = synapses.filter(F.col("weight") >= min_weight).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), (F.col("weight") * role_factor()).alias("factor"))
    e = e.groupBy("source", "target").agg(F.max("factor").alias("factor"))
    if states is not None:
        boost = 1 + F.least(F.lit(0.15), 0.05 * F.log1p(F.coalesce("access_frequency", F.lit(0)).cast("double")))
        e = e.join(states.select(F.col("id").alias("target"), "access_frequency"), "target", "left").select("source", "target", (F.col("factor") * boost).alias("factor"))
    return e


def spread(anchors: DataFrame, edges: DataFrame, *, max_hops: int = 4, decay: float = 0.5, min_level: float = 0.3, stop: tuple[float, int, int] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """query_id, node_id, level, hop: activation from anchors (query_id, node_id, level), hop by hop, the best level of each node kept.

    scope (query_id, node_id): the nodes that a query's activation may reach.

    stop: (ratio, least, grace): beyond `grace` hops a query goes on only while a hop finds `least` new nodes and `ratio` times those of the hop before.
    """
    edges = settled(edges)  # read once a hop
    reached = anchors.select("query_id", "node_id", F.col("level").cast("double").alias("level"), F.lit(0).alias("hop"))
    frontier = reached
    counts = [settled(reached.groupBy("query_id").agg(F.countDistinct("node_id").alias("n")))] if stop else []
    for hop in range(1, max_hops + 1):
        if stop and hop > stop[2] and hop > 1:
            before = counts[-2].withColumnRenamed("n", "prev")
            on = counts[-1].join(before, "query_id", "left").filter((F.col("n") >= stop[1]) & ~(F.coalesce(F.col("prev") > 0, F.lit(False)) & (F.col("n") / F.col("prev") < stop[0])))
            frontier = frontier.join(on.select("query_id"), "query_id", "left_semi")
        out = frontier.join(edges, F.col("node_id") == F.col("source")).select("query_id", F.col("target").alias("node_id"), (F.col("level") * decay * F.col("factor")).alias("level"))
        out = out.filter(F.col("level") >= min_level).groupBy("query_id", "node_id").agg(F.max("level").alias("level"))
        if scope is not None:
            out = out.join(scope, ["query_id", "node_id"], "left_semi")
        before = reached.groupBy("query_id", "node_id").agg(F.max("level").alias("best"))
        better = out.join(before, ["query_id", "node_id"], "left").filter(F.col("best").isNull() | (F.col("level") > F.col("best")))
        frontier = settled(better.select("query_id", "node_id", "level", F.lit(hop).alias("hop"), *([F.col("best").isNull().alias("new")] if stop else [])))
        if stop:
            counts.append(settled(frontier.filter("new").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))))
            frontier = frontier.drop("new")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    best = F.max_by(F.struct("level", "hop"), F.struct("level", -F.col("hop")))
    return reached.groupBy("query_id", "node_id").agg(best.alias("b")).select("query_id", "node_id", "b.level", "b.hop")


def ppr(seeds: DataFrame, synapses: DataFrame, *, damping: float = 0.15, rounds: int = 20, min_weight: float = 0.1, eps: float = 1e-6) -> DataFrame:
    """query_id, node_id, score: personalised PageRank in push form. seeds: query_id, node_id, mass. A node keeps `damping` of what reaches it; dead ends give back to the seeds."""
    e = synapses.filter(F.col("weight") >= min_weight).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "weight")
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("source"))
    e = settled(e.select("source", "target", share.alias("share")))
    total = F.sum("mass").over(Window.partitionBy("query_id"))
    start = settled(seeds.select("query_id", "node_id", (F.col("mass") / total).alias("mass")))
    dead_end = e.select(F.col("source").alias("node_id")).distinct()
    rest, kept = start, None
    for n in range(rounds):
        own = rest.select("query_id", "node_id", (F.col("mass") * damping).alias("mass"))
        kept = own if kept is None else kept.unionByName(own).groupBy("query_id", "node_id").agg(F.sum("mass").alias("mass"))
        push = rest.withColumn("mass", F.col("mass") * (1 - damping))
        on = push.join(e, F.col("node_id") == F.col("source")).select("query_id", F.col("target").alias("node_id"), (F.col("mass") * F.col("share")).alias("mass"))
        lost = push.join(dead_end, "node_id", "left_anti").groupBy("query_id").agg(F.sum("mass").alias("lost"))
        back = start.join(lost, "query_id").select("query_id", "node_id", (F.col("mass") * F.col("lost")).alias("mass"))
        rest = on.unionByName(back).groupBy("query_id", "node_id").agg(F.sum("mass").alias("mass")).filter(F.col("mass") >= eps)
        rest, kept = settled(rest), settled(kept)
        if rest.isEmpty():
            break
    best = F.max("mass").over(Window.partitionBy("query_id"))
    return kept.select("query_id", "node_id", (F.col("mass") / best).alias("score"))


def trail(anchors: DataFrame, pathways: DataFrame, *, decay: float = 0.15, min_level: float = 0.05) -> DataFrame:
    """query_id, node_id, level: activation along the pathways (fiber_id, position, node_id, conductivity) of fibers that hold an anchor, both ways."""
    at = pathways.select("fiber_id", F.col("node_id").alias("anchor"), F.col("position").alias("from"), "conductivity")
    hits = anchors.select("query_id", F.col("node_id").alias("anchor"), F.col("level").alias("start")).join(at, "anchor")
    walk = hits.join(pathways.select("fiber_id", "position", "node_id"), "fiber_id")
    level = F.col("start") * F.pow((1 - decay) * F.col("conductivity"), F.abs(F.col("position") - F.col("from")))
    return walk.select("query_id", "node_id", level.alias("level")).filter(F.col("level") >= min_level).groupBy("query_id", "node_id").agg(F.max("level").alias("level"))


def causal_chain(seeds: DataFrame, synapses: DataFrame, *, types: Sequence[str] = ("LEADS_TO",), max_depth: int = 3, min_weight: float = 0.0) -> DataFrame:
    """seed, node_id, depth, confidence: nodes reached over causal edges, at their first depth; confidence is the best geometric mean of weights there."""
    e = synapses.filter(F.col("type").isin(*types) & (F.col("weight") >= min_weight)).groupBy(F.col("source_id").alias("from"), F.col("target_id").alias("to")).agg(F.max("weight").alias("weight"))
    e = settled(e)
    seen = seeds.select(F.col("node_id").alias("seed"), "node_id", F.lit(0).alias("depth"), F.lit(0.0).alias("logs")).distinct()
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, F.col("node_id") == F.col("from")).select("seed", F.col("to").alias("node_id"), (F.col("logs") + F.log("weight")).alias("logs"))
        step = step.groupBy("seed", "node_id").agg(F.max("logs").alias("logs")).join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti")
        frontier = settled(step.select("seed", "node_id", F.lit(depth).alias("depth"), "logs"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0").select("seed", "node_id", "depth", F.exp(F.try_divide("logs", "depth")).alias("confidence"))


def expand_neighbors(anchors: DataFrame, synapses: DataFrame, *, most: int = 10, min_weight: float = 0.3) -> DataFrame:
    """query_id, node_id, weight: the strongest neighbours of a query's anchors that are not anchors."""
    e = synapses.filter(F.col("weight") >= min_weight)
    both = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight").union(e.select("target_id", "source_id", "weight"))
    near = anchors.select("query_id", F.col("node_id").alias("a")).join(both, "a").groupBy("query_id", F.col("b").alias("node_id")).agg(F.max("weight").alias("weight"))
    near = near.join(anchors.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "node_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= most)


def normalize_outgoing(synapses: DataFrame, *, budget: float = 5.0) -> DataFrame:
    """id, weight of edges whose source gives out more than the budget, scaled down to it. Totals are sums of decimals, so they don't depend on the order of the edges."""
    total = synapses.groupBy("source_id").agg(F.sum(F.col("weight").cast("decimal(38,18)")).cast("double").alias("total")).filter(F.col("total") > budget)
    return synapses.join(total, "source_id").select("id", (F.col("weight") * budget / F.col("total")).alias("weight"))


def clustering_coefficient(synapses: DataFrame) -> DataFrame:
    """node_id, degree, triangles, coefficient of nodes with two or more neighbours. Each triangle is found once, from its end of least degree, so hubs are not expanded.

    Nodes are numbered in the order of their degrees. The later neighbours of a node are one sorted array, and an edge is sent the rest of its
    first node's array, so wedges are packed numbers, not rows.
    """
    e = synapses.filter("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    e = settled(e)  # read for degrees and for both ends
    degree = e.select(F.col("a").alias("node_id")).union(e.select("b")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    nodes = settled(degree.orderBy("degree", "node_id").withColumn("no", F.monotonically_increasing_id()))
    number = lambda c: nodes.select(F.col("node_id").alias(c), F.col("no").alias(f"n{c}"))
    e = e.join(number("a"), "a").join(number("b"), "b").select(F.least("na", "nb").alias("u"), F.greatest("na", "nb").alias("v"))
    later = settled(e.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("later")))  # the root of twice the number of edges at most
    sent = later.filter(F.size("later") > 1).select("u", "later", F.posexplode("later").alias("at", "v")).filter(F.col("at") + 1 < F.size("later"))
    sent = sent.select("u", "v", F.slice("later", F.col("at") + 2, F.size("later")).alias("rest"))
    closed = sent.join(later.select(F.col("u").alias("v"), "later"), "v").select("u", "v", F.array_intersect("rest", "later").alias("w")).filter(F.size("w") > 0)
    ends = F.explode(F.concat(F.array(F.struct(F.col("u").alias("no"), F.size("w").alias("n")), F.struct(F.col("v").alias("no"), F.size("w").alias("n"))), F.transform("w", lambda x: F.struct(x.alias("no"), F.lit(1).alias("n")))))
    corners = closed.select(ends.alias("x")).groupBy(F.col("x.no").alias("no")).agg(F.sum("x.n").alias("triangles"))
    t = nodes.filter("degree >= 2").join(corners, "no", "left").select("node_id", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))
    return t.withColumn("coefficient", 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1)))
