"""Selections of nodes, fibers and typed memories. Every bound is explicit; there is no clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_neurons(neurons: DataFrame, *, type: str | None = None, exact: str | None = None, contains: str | None = None) -> DataFrame:
    """Nodes of a type, with a content, or whose content holds a text in any case."""
    if type is not None:
        neurons = neurons.filter(F.col("type") == type)
    if exact is not None:
        neurons = neurons.filter(F.col("content") == exact)
    if contains is not None:
        neurons = neurons.filter(F.contains(F.lower("content"), F.lit(contains.lower())))
    return neurons


def find_fibers(fibers: DataFrame, bridge: DataFrame, tags: DataFrame, *, contains_neuron: str | None = None, overlaps: tuple[int, int] | None = None, with_tags: Sequence[str] = (), tag_mode: str = "and", min_salience: float | None = None) -> DataFrame:
    """Fibers by member, time overlap (a null bound is open), tags (all or any, lower-cased) and salience."""
    if min_salience is not None:
        fibers = fibers.filter(F.col("salience") >= min_salience)
    if overlaps is not None:
        low, high = overlaps
        fibers = fibers.filter((F.col("created_day").isNull() | (F.col("created_day") <= high)) & (F.col("end_day").isNull() | (F.col("end_day") >= low)))
    if contains_neuron is not None:
        fibers = fibers.join(bridge.filter(F.col("neuron_id") == contains_neuron).select(F.col("fiber_id").alias("id")), "id", "left_semi")
    if with_tags:
        wanted = sorted({t.lower() for t in with_tags})
        found = tags.filter(F.lower("tag").isin(wanted)).groupBy(F.col("fiber_id").alias("id")).agg(F.countDistinct(F.lower("tag")).alias("n"))
        fibers = fibers.join(found.filter(F.col("n") >= (len(wanted) if tag_mode == "and" else 1)), "id", "left_semi")
    return fibers


def find_typed_memories(memories: DataFrame, *, type: str | None = None, tier: str | None = None, min_priority: int | None = None, as_of: Column | int | None = None) -> DataFrame:
    """Memories by type, tier and priority; with as_of, only those that have not expired."""
    if type is not None:
        memories = memories.filter(F.col("memory_type") == type)
    if tier is not None:
        memories = memories.filter(F.col("tier") == tier)
    if min_priority is not None:
        memories = memories.filter(F.col("priority") >= min_priority)
    if as_of is not None:
        memories = memories.filter(F.col("expires_day").isNull() | (F.col("expires_day") > as_of))
    return memories


def expired(memories: DataFrame, as_of: Column | int) -> DataFrame:
    return memories.filter(F.col("expires_day") <= as_of)


def expiring_within(memories: DataFrame, as_of: Column | int, days: int) -> DataFrame:
    return memories.filter((F.col("expires_day") > as_of) & (F.col("expires_day") <= F.lit(as_of) + days))


def valid_at(items: DataFrame, at: Column | int, start: str, end: str) -> DataFrame:
    """Items whose validity holds at a time; a null bound is open."""
    return items.filter((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) >= at)))


def promotion_candidates(memories: DataFrame, fibers: DataFrame, *, min_frequency: int = 5, type: str = "context") -> DataFrame:
    """Unpinned fibers of a type that are used often."""
    m = memories.filter((F.col("memory_type") == type) & ~F.col("pinned")).select(F.col("fiber_id").alias("id"))
    return fibers.filter(F.col("frequency") >= min_frequency).join(m, "id").select(F.col("id").alias("fiber_id"), "frequency", "conductivity")


def pinned_neurons(fibers: DataFrame, bridge: DataFrame) -> DataFrame:
    """Nodes of pinned fibers, which decay, prune and interference spare."""
    pinned = fibers.filter("pinned").select(F.col("id").alias("fiber_id"))
    return bridge.join(pinned, "fiber_id", "left_semi").select("brain_id", "neuron_id").distinct()


def stale_fibers(fibers: DataFrame, as_of: Column | int, days: int) -> DataFrame:
    """Unpinned fibers not touched for some days."""
    return fibers.filter(~F.col("pinned") & (F.lit(as_of) - F.col("end_day") >= days))


def extract_subgraph(fibers: DataFrame, bridge: DataFrame, synapses: DataFrame, *, min_salience: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fibers by salience, the nodes in them, and the edges with both ends among these."""
    kept = fibers.filter(F.col("salience") >= min_salience)
    nodes = bridge.join(kept.select(F.col("id").alias("fiber_id")), "fiber_id", "left_semi").select("neuron_id").distinct()
    edges = synapses.join(nodes.select(F.col("neuron_id").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("neuron_id").alias("target_id")), "target_id", "left_semi")
    return kept, nodes, edges


def status_in(fibers: DataFrame, active: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Fibers of an allowed status whose anchor is active."""
    return fibers.filter(F.col("status").isin(*allowed)).join(active.select("anchor").distinct(), "anchor", "left_semi")


def scope_boost(memories: DataFrame, *, as_of: Column | int, window_days: int) -> DataFrame:
    """Memories with a boost for being recent and for being important."""
    recent = F.when(F.lit(as_of) - F.col("created_day") <= window_days, 1.2).otherwise(1.0)
    return memories.withColumn("boost", recent * F.when(F.col("priority") >= 7, 1.1).otherwise(1.0))
