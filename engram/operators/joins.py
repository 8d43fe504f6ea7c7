"""Neighbourhoods, overlaps and links between memories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edge types that can be walked both ways.
BIDIRECTIONAL = ("CO_OCCURS", "RELATED_TO", "SIMILAR_TO", "NEAR", "USED_WITH")


def neighbors(frontier: DataFrame, synapses: DataFrame, *, direction: str = "both", types: Sequence[str] | None = None, min_weight: float | None = None) -> DataFrame:
    """node_id, neighbor_id, edge_id, type, weight. "in" alone takes only edges that can be walked both ways; "both" takes every edge once."""
    if types:
        synapses = synapses.filter(F.col("type").isin(*types))
    if min_weight is not None:
        synapses = synapses.filter(F.col("weight") >= min_weight)
    out = synapses.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbor_id"), F.col("id").alias("edge_id"), "type", "weight")
    into = synapses.filter(F.col("type").isin(*BIDIRECTIONAL)) if direction == "in" else synapses
    into = into.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbor_id"), F.col("id").alias("edge_id"), "type", "weight")
    if direction == "both":
        edges = out.unionByName(into.filter("node_id <> neighbor_id"))
    else:
        edges = out if direction == "out" else into
    return edges.join(frontier.select("node_id").distinct(), "node_id", "left_semi")


def synapses_for(nodes: DataFrame, synapses: DataFrame, *, direction: str = "out") -> DataFrame:
    end = "source_id" if direction == "out" else "target_id"
    return synapses.join(nodes.select(F.col("node_id").alias(end)).distinct(), end, "left_semi")


def fibers_for_neurons(nodes: DataFrame, bridge: DataFrame, fibers: DataFrame, *, limit_per_neuron: int) -> DataFrame:
    """The most salient fibers of each node, each fiber once."""
    both = bridge.join(nodes.select(F.col("node_id").alias("neuron_id")).distinct(), "neuron_id", "left_semi").join(fibers.select(F.col("id").alias("fiber_id"), "salience"), "fiber_id")
    rank = F.row_number().over(Window.partitionBy("neuron_id").orderBy(F.col("salience").desc(), "fiber_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= limit_per_neuron).select("fiber_id", "salience").distinct()


def new_pairs_only(pairs: DataFrame, synapses: DataFrame) -> DataFrame:
    """Pairs (a < b) between which no edge runs either way."""
    linked = synapses.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    return pairs.join(linked, ["a", "b"], "left_anti")


def temporal_binding(fibers: DataFrame, *, window: int, most: int = 3, by: str = "brain_id") -> DataFrame:
    """Anchors of the fibers that were active within `window` before a fiber, nearest first; weight 0.4 at no gap, at least 0.1.

    Of all fibers of one time those of the first ids are enough: `most` of an anchor, and twice `most` in all, as only one anchor of these can be a
    fiber's own. So each time has one short list. Times are laid into slots of the window's length, so the join is on equal keys (a slot or the one before).
    """
    f = fibers.select(by, F.col("id").alias("fiber_id"), "anchor", F.col("created_day").alias("at"))

    def first(rows: DataFrame, *order: str | Column) -> DataFrame:
        """The rows that any fiber of a time can need."""
        own = F.row_number().over(Window.partitionBy(by, "at", "other").orderBy(*order))
        place = F.row_number().over(Window.partitionBy(by, "at").orderBy(*order))
        return rows.withColumn("own", own).filter(F.col("own") <= most).withColumn("place", place).filter(F.col("place") <= 2 * most).drop("own", "place")

    c = first(f.filter("anchor is not null").select(by, "at", F.col("fiber_id").alias("other_id"), F.col("anchor").alias("other")), "other_id").withColumnRenamed("at", "other_at")
    right = c.withColumn("slot", F.explode(F.array(F.floor(F.col("other_at") / window), F.floor(F.col("other_at") / window) + 1)))
    times = f.select(by, "at").distinct().withColumn("slot", F.floor(F.col("at") / window))
    near = times.join(right, [by, "slot"]).filter((F.col("other_at") <= F.col("at")) & (F.col("other_at") >= F.col("at") - window))
    near = first(near, F.col("other_at").desc(), "other_id").groupBy(by, "at").agg(F.sort_array(F.collect_list(F.struct((F.col("at") - F.col("other_at")).alias("gap"), "other_id", "other"))).alias("near"))  # 2 * most at most
    out = f.join(near, [by, "at"]).select(by, "fiber_id", "anchor", F.explode(F.slice(F.filter("near", lambda x: x["other"] != F.col("anchor")), 1, most)).alias("x"))
    return out.select(by, "fiber_id", "anchor", F.col("x.other").alias("target_id"), F.greatest(F.lit(0.1), 0.4 * (1 - F.col("x.gap") / window)).alias("weight"))


def temporal_range(fibers: DataFrame, start: int, end: int) -> DataFrame:
    """Fibers whose time overlaps a range; those without a start are left out."""
    return fibers.filter(F.col("created_day").isNotNull() & (F.col("created_day") <= end) & (F.coalesce("end_day", "created_day") >= start))


def cooccur_within(events: DataFrame, *, window_us: int, key: Column, min_frequency: int = 1) -> DataFrame:
    """(a < b, n): events with different keys in one session at most a window apart; slots keep the join on equal keys."""
    e = events.select("session_id", "id", key.alias("k"), "at_us")
    left = e.withColumn("slot", F.floor(F.col("at_us") / window_us))
    right = e.select("session_id", F.col("id").alias("id2"), F.col("k").alias("k2"), F.col("at_us").alias("at2"), F.explode(F.array(*[F.floor(F.col("at_us") / window_us) + d for d in (0, 1)])).alias("slot"))
    both = left.join(right, ["session_id", "slot"]).filter((F.col("k") != F.col("k2")) & (F.abs(F.col("at_us") - F.col("at2")) <= window_us))
    both = both.filter((F.col("at2") < F.col("at_us")) | ((F.col("at2") == F.col("at_us")) & (F.col("id2") < F.col("id"))))
    return both.groupBy(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_frequency)
