"""Hashes, Merkle buckets and merges of two sides of a brain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merkle_buckets(items: DataFrame, *, key: str, updated: Column, content: Column) -> DataFrame:
    """bucket, hash, n: leaves are hashes of id, time and content; a bucket, by the first two characters of the leaf, is the hash of its sorted leaves."""
    leaf = F.sha2(F.concat_ws("|", F.col(key), updated.cast("string"), content).cast("binary"), 256)
    t = items.select(leaf.alias("leaf")).withColumn("bucket", F.substring("leaf", 1, 2))
    joined = F.array_join(F.sort_array(F.collect_list("leaf")), "|")
    return t.groupBy("bucket").agg(F.sha2(joined.cast("binary"), 256).alias("hash"), F.count(F.lit(1)).alias("n"))


def merkle_root(buckets: DataFrame) -> DataFrame:
    """The hash over the at most 256 buckets."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "hash"))), lambda x: x["hash"]), "|")
    return buckets.agg(F.sha2(joined.cast("binary"), 256).alias("root"))


def merkle_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets that differ between two sides."""
    x, y = a.select("bucket", F.col("hash").alias("x")), b.select("bucket", F.col("hash").alias("y"))
    return x.join(y, "bucket", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select("bucket", F.when(F.col("x").isNull(), "right").when(F.col("y").isNull(), "left").otherwise("both").alias("side"))


def fingerprint(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A hash of the mutable columns of each row."""
    return df.select(key, F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"), 256).alias("hash"))


def latest_changes(changes: DataFrame) -> DataFrame:
    """The newest change of each entity. changes: entity_id, sequence, operation, weight."""
    return changes.groupBy("entity_id").agg(F.max_by(F.struct("operation", "weight"), "sequence").alias("c"), F.max("sequence").alias("sequence")).select("entity_id", "sequence", "c.operation", "c.weight")


def merge_changes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """entity_id, operation, weight: a delete on either side wins, else the larger weight; local and remote are latest changes."""
    a = local.select("entity_id", F.col("operation").alias("op_a"), F.col("weight").alias("w_a"))
    b = remote.select("entity_id", F.col("operation").alias("op_b"), F.col("weight").alias("w_b"))
    gone = (F.coalesce("op_a", F.lit("")) == "delete") | (F.coalesce("op_b", F.lit("")) == "delete")
    return a.join(b, "entity_id", "full_outer").select("entity_id", F.when(gone, "delete").otherwise("upsert").alias("operation"), F.when(~gone, F.greatest("w_a", "w_b")).alias("weight"))
