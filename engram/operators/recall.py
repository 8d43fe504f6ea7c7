"""Recall from its query side: when to stop, mixed activation, greedy budgets, chunks and explanations. Queries are rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators import graph


def stop_rule(trace: DataFrame, *, ratio: float = 0.15, least: int = 2, grace: int = 1) -> DataFrame:
    """query_id, stop: the first hop that should not be explored, because the one before found fewer than `least` nodes or less than
    `ratio` of those of the hop before it. trace: query_id, hop (0 for anchors), n (nodes first reached there). The first `grace` hops are always explored."""
    before = trace.select("query_id", (F.col("hop") + 1).alias("hop"), F.col("n").alias("prev"))
    t = trace.join(before, ["query_id", "hop"], "left")
    few = (F.col("n") < least) | ((F.col("prev") > 0) & (F.col("n") / F.col("prev") < ratio))
    last = t.groupBy("query_id").agg(F.min(F.when((F.col("hop") >= grace) & few, F.col("hop") + 1)).alias("stop"), F.max("hop").alias("deepest"))
    # a hop that found nothing has no row
    return last.select("query_id", F.coalesce("stop", F.greatest(F.col("deepest") + 2, F.lit(grace + 1))).alias("stop"))


def hybrid(anchors: DataFrame, edges: DataFrame, pathways: DataFrame, *, max_hops: int = 4, discovery: float = 0.6, min_level: float = 0.1) -> DataFrame:
    """query_id, node_id, level: activation along the pathways of fibers, and over half of the hops of the graph, damped, where that is more. A query whose anchors are in no fiber goes over all hops, undamped."""
    primary = graph.trail(anchors, pathways)
    has = anchors.join(pathways.select("node_id").distinct(), "node_id", "left_semi").select("query_id").distinct()
    near = graph.spread(anchors.join(has, "query_id", "left_semi"), edges, max_hops=max(1, max_hops // 2), min_level=min_level)
    far = graph.spread(anchors.join(has, "query_id", "left_anti"), edges, max_hops=max_hops, min_level=min_level)
    every = primary.unionByName(near.select("query_id", "node_id", (F.col("level") * discovery).alias("level"))).unionByName(far.select("query_id", "node_id", "level"))
    return every.groupBy("query_id", "node_id").agg(F.max("level").alias("level"))


def greedy_budget(items: DataFrame, *, by: str, value: Column, tokens: Column, budget: int) -> DataFrame:
    """(by, id, used): items by value for each token, each taken if it still fits, so a large one doesn't end the list. A group's candidates are one array."""
    t = items.select(by, "id", tokens.cast("int").alias("tokens"), F.round(value / tokens, 9).alias("density"))
    group = t.groupBy(by).agg(F.sort_array(F.collect_list(F.struct((-F.col("density")).alias("d"), "id", "tokens"))).alias("items"))
    fits = lambda a, x: a["used"] + x["tokens"] <= budget
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<id:string,used:int>>").alias("taken"))
    step = lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["tokens"]).alias("used"), F.array_append(a["taken"], F.struct(x["id"].alias("id"), (a["used"] + x["tokens"]).alias("used"))).alias("taken"))).otherwise(a)
    return group.select(by, F.explode(F.aggregate("items", start, step, lambda a: a["taken"])).alias("t")).select(by, "t.id", "t.used")


def explain(activations: DataFrame, *, k: int = 5, boost: float = 1.5, single: float = 0.8) -> DataFrame:
    """query_id, node_id, rank, score, boosted, method: the first k contributors of each query. activations: query_id, source (anchor),
    node_id, level. A node that several anchors reach counts `boost` times; one beyond `single` answers alone (method single), else several do (multi)."""
    a = activations.groupBy("query_id", "node_id").agg(F.max("level").alias("level"), F.countDistinct("source").alias("sources"))
    a = a.withColumn("boosted", F.col("sources") > 1).withColumn("score", F.when(F.col("boosted"), F.col("level") * boost).otherwise(F.col("level")))
    a = a.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "node_id"))).filter(F.col("rank") <= k)
    top = F.max("score").over(Window.partitionBy("query_id"))
    return a.withColumn("method", F.when(top > single, "single").otherwise("multi")).select("query_id", "node_id", "rank", "score", "boosted", "method")


CHUNKS = "query_id string, chunk int, node_ids array<string>, coherence double, relevance double"


def chunk_results(activations: DataFrame, edges: DataFrame, *, most: int = 5, size: int = 4) -> DataFrame:
    """query_id, chunk, node_ids, coherence, relevance: results of a query in chunks, each grown from the strongest result and its
    heaviest edges until the next strongest is taken already; what is left fills up as single nodes. activations: query_id, node_id,
    level; edges: source, target, weight. Only edges between results of a query are looked at; a query's results are one group."""
    a = activations.select("query_id", "node_id", "level")
    own = a.select("query_id", F.col("node_id").alias("source")).join(edges, "source").join(a.select("query_id", F.col("node_id").alias("target")), ["query_id", "target"])
    e = own.groupBy("query_id", F.col("source").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("target", "weight"))).alias("out"))
    rows = a.join(e, ["query_id", "node_id"], "left")

    def cut(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["level", "node_id"], ascending=[False, True])
        level = dict(zip(t["node_id"], t["level"], strict=True))
        pairs = [(s, x["target"], x["weight"]) for s, out in zip(t["node_id"], t["out"], strict=True) if out is not None for x in out]
        near: dict[str, list] = {}
        for s, z, w in pairs:
            near.setdefault(s, []).append((-w, z))
            near.setdefault(z, []).append((-w, s))
        taken, chunks = set(), []
        for seed in level:
            if seed in taken or len(chunks) == most:
                break
            chunk = [seed, *[z for _, z in sorted(near.get(seed, [])) if z != seed and z not in taken]]
            chunk = list(dict.fromkeys(chunk))[:size]
            taken |= set(chunk)
            inner = [w for s, z, w in pairs if s in chunk and z in chunk]
            chunks.append((chunk, sum(inner) / len(inner) if inner else 0.0, sum(level[x] for x in chunk) / len(chunk)))
        chunks += [([x], 0.0, level[x]) for x in level if x not in taken and level[x] > 0][: most - len(chunks)]
        chunks.sort(key=lambda c: -round(c[2], 4))
        return pd.DataFrame([(t["query_id"].iloc[0], i + 1, c, round(co, 4), round(re, 4)) for i, (c, co, re) in enumerate(chunks)], columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return rows.groupBy("query_id").applyInPandas(cut, CHUNKS)


def causal_supplement(selected: DataFrame, chains: DataFrame, texts: DataFrame, *, chars: int = 600) -> DataFrame:
    """query_id, node_id, depth, confidence, used: nodes that chains (seed, node_id, depth, confidence) reach from the selected ones
    (query_id, node_id), without these, strongest first while their texts (node_id, size) fit in `chars`."""
    to = chains.select("seed", F.col("node_id").alias("to"), "depth", "confidence")
    hits = selected.withColumnRenamed("node_id", "seed").join(to, "seed").select("query_id", F.col("to").alias("node_id"), "depth", "confidence")
    new = hits.join(selected, ["query_id", "node_id"], "left_anti").groupBy("query_id", "node_id").agg(F.max_by(F.struct("depth", "confidence"), F.struct(F.round("confidence", 9), -F.col("depth"))).alias("c"))
    new = new.select("query_id", "node_id", "c.*").join(texts, "node_id")
    used = F.sum("size").over(Window.partitionBy("query_id").orderBy(F.round("confidence", 9).desc(), "depth", "node_id").rowsBetween(Window.unboundedPreceding, 0))
    return new.withColumn("used", used).filter(F.col("used") <= chars).select("query_id", "node_id", "depth", "confidence", "used")
