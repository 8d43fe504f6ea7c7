"""Health and growth of brains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def health(neurons: DataFrame, synapses: DataFrame, states: DataFrame, fibers: DataFrame, *, as_of: Column | int) -> DataFrame:
    """brain_id, connectivity, diversity, freshness, orphan_rate, activation: the parts of a brain's health, each 0..1."""
    n = neurons.groupBy("brain_id").agg(F.count(F.lit(1)).alias("n"))
    s = synapses.groupBy("brain_id").agg(F.count(F.lit(1)).alias("e"))
    kinds = synapses.groupBy("brain_id", "type").agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("brain_id"))
    entropy = kinds.withColumn("p", share).groupBy("brain_id").agg((-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(8.0))).alias("diversity"))
    fresh = fibers.groupBy("brain_id").agg(F.avg((F.lit(as_of) - F.col("created_day") <= 7).cast("double")).alias("freshness"))
    ends = synapses.select("source_id").union(synapses.select("target_id")).distinct().withColumnRenamed("source_id", "id")
    linked = neurons.join(ends, "id", "left_semi").groupBy("brain_id").agg(F.count(F.lit(1)).alias("linked"))
    active = states.groupBy("brain_id").agg(F.avg((F.col("access_frequency") > 0).cast("double")).alias("activation"))
    t = n
    for x in (s, entropy, fresh, linked, active):
        t = t.join(x, "brain_id", "left")
    per_node = F.coalesce("e", F.lit(0)) / F.col("n")
    return t.select(
        "brain_id", (1 / (1 + F.exp(-1.5 * (per_node - 3)))).alias("connectivity"), F.least(F.lit(1.0), F.coalesce("diversity", F.lit(0.0))).alias("diversity"), F.coalesce("freshness", F.lit(0.0)).alias("freshness"),
        (1 - F.coalesce("linked", F.lit(0)) / F.col("n")).alias("orphan_rate"), F.coalesce("activation", F.lit(0.0)).alias("activation"),
    )


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def milestones(days: DataFrame, thresholds: Sequence[int] = (100, 250, 500, 1000, 2500, 5000, 10000)) -> DataFrame:
    """threshold, day: when a brain's running number of nodes passes each threshold. days: brain_id, day (one row a node); counts for each day are summed, not rows."""
    per_day = days.filter("day is not null").groupBy("brain_id", "day").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("brain_id").orderBy("day"))
    run = per_day.withColumn("total", upto).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col("total") >= F.col("threshold"))
    return run.groupBy("brain_id", "threshold").agg(F.min("day").alias("day"))


def stage_progress(records: DataFrame, *, as_of: Column | int) -> DataFrame:
    """fiber_id, time_progress, spacing_progress, progress toward the semantic stage."""
    time = F.least(F.lit(1.0), (F.lit(as_of) - F.col("entered_day")) / 3.0)
    spacing = F.least(F.lit(1.0), F.col("days") / 3.0)
    return records.select("fiber_id", time.alias("time_progress"), spacing.alias("spacing_progress"), F.least(time, spacing).alias("progress"))

#: Weights of the parts of health; orphans count against it.
PART_WEIGHT = {"connectivity": 0.25, "diversity": 0.2, "freshness": 0.15, "orphan_rate": 0.1, "activation": 0.05}


def penalties(parts: DataFrame) -> DataFrame:
    """brain_id, part, penalty: what each part of health costs a brain."""
    each = [F.struct(F.lit(p).alias("part"), (w * (F.col(p) if p == "orphan_rate" else 1 - F.col(p))).alias("penalty")) for p, w in PART_WEIGHT.items()]
    return parts.select("brain_id", F.explode(F.array(*each)).alias("x")).select("brain_id", "x.*")
