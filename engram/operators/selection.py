"""Choosing among bounded candidates, views of the past, versions on disk, and small repairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def diverse(scored: DataFrame, members: DataFrame, *, n: int = 10, overlap: float = 0.6, penalty: float = 0.7, candidates: int = 50) -> DataFrame:
    """query_id, fiber_id, score, rank: candidates in order of score, leaving out those that share most nodes with a chosen one, unless their score stays above half of the last chosen.

    scored: query_id, fiber_id, score; members: fiber_id, neuron_id. A group holds the first `candidates` rows of a query, by rank.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "fiber_id"))
    few = scored.withColumn("place", rank).filter(F.col("place") <= candidates)
    nodes = members.join(few.select("fiber_id").distinct(), "fiber_id", "left_semi").groupBy("fiber_id").agg(F.collect_set("neuron_id").alias("nodes"))
    few = few.join(nodes, "fiber_id")

    def choose(t: pd.DataFrame) -> pd.DataFrame:
        chosen = []
        for r in t.sort_values("place").itertuples():
            own = set(r.nodes)
            most = max((len(own & s) / len(own | s) for _, s, _ in chosen), default=0.0)
            if most > overlap and r.score * (1 - most * penalty) < 0.5 * chosen[-1][2]:
                continue
            chosen.append((r.fiber_id, own, r.score))
            if len(chosen) == n:
                break
        return pd.DataFrame({"query_id": t["query_id"].iloc[0], "fiber_id": [c[0] for c in chosen], "score": [c[2] for c in chosen], "rank": range(1, len(chosen) + 1)})

    return few.groupBy("query_id").applyInPandas(choose, "query_id string, fiber_id string, score double, rank int")


def as_of_view(fibers: DataFrame, at: int) -> DataFrame:
    """Fibers as they stood on a day: those created by then, their end no later."""
    return fibers.filter(F.col("created_day") <= at).withColumn("end_day", F.least(F.col("end_day"), F.lit(at)))


def create_version(spark: SparkSession, items: DataFrame, path: str, version: int, key: str) -> str:
    """Writes a numbered version; returns a hash over its rows that does not depend on their order."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(items.columns)]).cast("binary"), 256)
    items.write.mode("errorifexists").parquet(f"{path}/version={version}")
    parts = items.select(F.substring(row, 1, 3).alias("p"), row.alias("h")).groupBy("p").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "|").cast("binary"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "|").cast("binary"), 256)).head()[0]


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def habit_edges(pairs: DataFrame, *, sessions: int, min_frequency: int) -> DataFrame:
    """source, target, weight: BEFORE edges between actions that follow each other often, by their share of sessions, at most 1."""
    return pairs.filter(F.col("cnt") >= min_frequency).select(F.col("a").alias("source"), F.col("b").alias("target"), F.least(F.lit(1.0), F.col("cnt") / sessions).alias("weight"))


def reactivate_dormant(states: DataFrame, *, n: int = 20, seed: int = 0, delta: float = 0.05) -> DataFrame:
    """id, level of n never used nodes of each brain, chosen by seeded hash."""
    w = Window.partitionBy("brain_id").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    return states.filter("access_frequency = 0").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("id", F.least(F.lit(1.0), F.col("activation_level") + delta).alias("level"))


def event_sequence(fibers: DataFrame, *, most: int = 10) -> DataFrame:
    """anchor, fiber_id, position: the first events of each anchor in time."""
    w = Window.partitionBy("anchor").orderBy("created_day", "id")
    return fibers.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most).select("anchor", F.col("id").alias("fiber_id"), "position")


def quantize_int8(vector: Column) -> tuple[Column, Column, Column]:
    """(codes 0..255, least, step) of a vector; value is about least + code * step."""
    low, high = F.array_min(vector).cast("double"), F.array_max(vector).cast("double")
    step = F.greatest((high - low) / 255, F.lit(1e-12))
    return F.transform(vector, lambda x: F.round((x.cast("double") - low) / step).cast("int")), low, step


def consolidation_delta(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """brain_id, metric, before, after, delta."""
    long = lambda df, name: df.select("brain_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("x")).select("brain_id", "x.*")
    return long(before, "before").join(long(after, "after"), ["brain_id", "metric"]).withColumn("delta", F.col("after") - F.col("before"))


def expand_terms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query_id, term: terms of queries with their synonyms, each once."""
    more = queries.join(synonyms, "term").select("query_id", F.col("expansion").alias("term"))
    return queries.select("query_id", "term").unionByName(more).distinct()
