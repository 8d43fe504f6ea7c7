"""Recall that starts from a search: by vectors and words, by ranked anchors, by what a session has touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators import graph

#: Nearest vectors below which a query's recall is not confined to what it found.
LEAST_FOUND = 10


def hybrid_vector_recall(nearest: DataFrame, texts: DataFrame, anchors: DataFrame, edges: DataFrame, *, max_hops: int = 2, min_level: float = 0.1, least: int = LEAST_FOUND) -> DataFrame:
    """query_id, node_id, level, scoped: activation from anchors within the nodes that a search found.

    nearest: query_id, node_id, rank (by vector); texts: query_id, node_id (by words); anchors: query_id, node_id, level; edges as in
    graph.spread. Vectors found, texts found and anchors are a query's scope; a node that its vector found gains 1 / (60 + rank), to 1
    at most. A query with fewer than `least` vectors goes over the whole graph, without that gain.
    """
    nearest = graph.settled(nearest.select("query_id", "node_id", "rank"))  # searched once
    enough = nearest.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("query_id")
    scope = nearest.select("query_id", "node_id").unionByName(texts.select("query_id", "node_id")).unionByName(anchors.select("query_id", "node_id")).distinct()
    confined = graph.spread(anchors.join(enough, "query_id", "left_semi"), edges, max_hops=max_hops, min_level=min_level, scope=graph.settled(scope))
    free = graph.spread(anchors.join(enough, "query_id", "left_anti"), edges, max_hops=max_hops, min_level=min_level)
    gain = F.coalesce(1 / (60 + F.col("rank")), F.lit(0.0))
    confined = confined.join(nearest, ["query_id", "node_id"], "left").select("query_id", "node_id", F.least(F.lit(1.0), F.col("level") + gain).alias("level"), F.lit(True).alias("scoped"))
    return confined.unionByName(free.select("query_id", "node_id", "level", F.lit(False).alias("scoped")))
