"""Differences of snapshots and combinations of activation sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, *, key: str, values: Sequence[str]) -> DataFrame:
    """key and change (added, removed, modified) of rows that differ between two snapshots."""
    a = old.select(key, F.struct(*values).alias("old"))
    b = new.select(key, F.struct(*values).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def weight_changes(old: DataFrame, new: DataFrame, *, key: str = "id", least: float = 1e-6) -> DataFrame:
    a, b = old.select(key, F.col("weight").alias("old_weight")), new.select(key, F.col("weight").alias("new_weight"))
    return a.join(b, key).filter(F.abs(F.col("old_weight") - F.col("new_weight")) > least)


def intersect_activations(activations: DataFrame, *, least: int = 2) -> DataFrame:
    """Nodes that several anchor sets reach."""
    return activations.groupBy("query_id", "node_id").agg(F.countDistinct("anchor_set").alias("sets"), F.sum("level").alias("total")).filter(F.col("sets") >= least)


def combine_anchor_sets(activations: DataFrame) -> DataFrame:
    """One activation for each query and node: sets in order, the level grows by half of each further one, up to 1."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("anchor_set", "level"))), lambda x: x["level"])
    grouped = activations.groupBy("query_id", "node_id").agg(ordered.alias("levels"), F.min("hop").alias("hop"))
    fold = F.aggregate(F.slice("levels", 2, 1_000_000), F.col("levels")[0], lambda a, x: F.least(F.lit(1.0), a + 0.5 * x))
    return grouped.select("query_id", "node_id", fold.alias("level"), "hop")


def fuzzy_and(a: DataFrame, b: DataFrame, norm: str = "product") -> DataFrame:
    """Scores of nodes in both, by a t-norm."""
    x, y = F.col("a"), F.col("b")
    value = {"product": x * y, "min": F.least(x, y), "lukasiewicz": F.greatest(F.lit(0.0), x + y - 1)}[norm]
    return a.withColumnRenamed("score", "a").join(b.withColumnRenamed("score", "b"), ["query_id", "node_id"]).select("query_id", "node_id", value.alias("score"))


def fuzzy_or(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return a.withColumnRenamed("score", "a").join(b.withColumnRenamed("score", "b"), ["query_id", "node_id"], "full_outer").select("query_id", "node_id", (x + y - x * y).alias("score"))


def fuzzy_not(base: DataFrame, child: DataFrame) -> DataFrame:
    joined = base.withColumnRenamed("score", "a").join(child.withColumnRenamed("score", "b"), ["query_id", "node_id"], "left")
    return joined.select("query_id", "node_id", (F.col("a") * (1 - F.coalesce("b", F.lit(0.0)))).alias("score"))
