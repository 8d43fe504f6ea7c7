"""Consolidation strategies: each takes whole tables and returns a delta or a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import formulas
from engram.operators.joins import new_pairs_only

#: How fast the nodes of a tier decay, and the least level they keep.
TIER_RATE = {"hot": (0.5, 0.5), "warm": (1.0, 0.0), "cold": (2.0, 0.0)}
#: Edge types that pruning spares.
CAUSAL = ("CAUSED_BY", "LEADS_TO", "ENABLES", "PREVENTS")


def decay(states: DataFrame, tiers: DataFrame, pinned: DataFrame, *, as_of: Column | int, least_days: int = 1) -> DataFrame:
    """id, level of nodes after decay: rate and floor by tier (warm where unknown); pinned nodes and those used within least_days are spared."""
    t = states.join(pinned.select(F.col("neuron_id").alias("id")), "id", "left_anti").join(tiers.select("id", "tier"), "id", "left").withColumn("tier", F.coalesce("tier", F.lit("warm")))
    days = F.lit(as_of) - F.coalesce("last_day", "created_day")
    rate = F.when(F.col("tier") == "hot", TIER_RATE["hot"][0]).when(F.col("tier") == "cold", TIER_RATE["cold"][0]).otherwise(TIER_RATE["warm"][0])
    floor = F.when(F.col("tier") == "hot", TIER_RATE["hot"][1]).otherwise(0.0)
    level = formulas.neuron_decay(F.col("activation_level"), F.col("decay_rate") * rate, days.cast("double"))
    t = t.withColumns({"days": days, "level": F.greatest(F.least(floor, F.col("activation_level")), level)})
    return t.filter((F.col("days") >= least_days) & (F.col("activation_level") > 0)).select("id", "level")


def prunable(synapses: DataFrame, pinned: DataFrame, *, as_of: Column | int, threshold: float = 0.05, idle_days: int = 7) -> DataFrame:
    """Edges whose weight after time decay is below the threshold: not causal, not idle for too short, no pinned end, and not the only way on from their source."""
    days = F.lit(as_of) - F.coalesce("last_day", F.lit(0))
    weight = formulas.synapse_time_decay(F.col("weight"), F.col("reinforced_count"), 24.0 * days)
    weight = F.when(F.col("type").isin("CO_OCCURS", "ALIAS") & (F.col("reinforced_count") < 3), weight * 0.33).otherwise(weight)
    ways = synapses.groupBy("source_id").agg(F.countDistinct("target_id").alias("ways"))
    e = synapses.filter(~F.col("type").isin(*CAUSAL)).withColumn("left", weight).filter((F.col("left") < threshold) & (days >= idle_days))
    e = e.join(pinned.select(F.col("neuron_id").alias("source_id")), "source_id", "left_anti").join(pinned.select(F.col("neuron_id").alias("target_id")), "target_id", "left_anti")
    e = e.join(ways, "source_id").filter((F.col("ways") > 1) | (F.col("weight") < 0.01))
    return e.select("id", "left")


def mature(records: DataFrame, *, as_of: Column | int) -> DataFrame:
    """fiber_id, stage: by age in days and rehearsals on distinct days. records: fiber_id, entered_day, rehearsals, days."""
    age = F.lit(as_of) - F.col("entered_day")
    spaced = (F.col("days") >= 2) | ((F.col("rehearsals") >= 5) & (F.col("days") >= 3))
    stage = F.when((age >= 3) & spaced, "semantic").when((age >= 1) & (F.col("rehearsals") >= 10), "semantic").when(age >= 1, "episodic").otherwise("working")
    return records.select("fiber_id", stage.alias("stage"))


def infer_links(counts: DataFrame, synapses: DataFrame, *, start: float = 0.3, most: float = 0.5, scale: float = 0.1, least: int = 3, top: int = 50) -> DataFrame:
    """New CO_OCCURS pairs (a, b, weight) out of co-activation counts, where no edge runs yet; the best `top`."""
    frequent = counts.filter(F.col("cnt") >= least)
    weight = F.least(F.lit(most), start + scale * (F.col("cnt") - least) * F.col("avg_strength"))
    return new_pairs_only(frequent, synapses).select("a", "b", weight.alias("weight"), "cnt").orderBy(F.col("cnt").desc(), "a", "b").limit(top).drop("cnt")


def transitive_links(synapses: DataFrame, *, type: str = "CAUSED_BY", factor: float = 0.5) -> DataFrame:
    """source_id, target_id, weight of edges a to c over some b, at half the weaker of the strongest way, where none of the type runs yet."""
    e = synapses.filter(F.col("type") == type).select("source_id", "target_id", "weight")
    two = e.alias("x").join(e.alias("y"), F.col("x.target_id") == F.col("y.source_id")).filter(F.col("x.source_id") != F.col("y.target_id"))
    two = two.groupBy(F.col("x.source_id").alias("source_id"), F.col("y.target_id").alias("target_id")).agg((factor * F.max(F.least("x.weight", "y.weight"))).alias("weight"))
    return two.join(e.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")


def tool_links(events: DataFrame, *, min_frequency: int = 3) -> DataFrame:
    """tool, task, cnt, weight: EFFECTIVE_FOR edges from tools to the tasks in which they often succeed."""
    return events.filter("success").groupBy(F.col("action").alias("tool"), "task").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= min_frequency).withColumn("weight", F.lit(0.4))


def activation_drift(values: DataFrame, *, by: str) -> DataFrame:
    """The Wasserstein distance between two periods' distributions of a value: by, period (0 or 1), value -> by, w1. Sorted values of both periods meet in one running sum."""
    w = Window.partitionBy(by).orderBy("value")
    sizes = values.groupBy(by).agg(F.sum((F.col("period") == 0).cast("long")).alias("n0"), F.sum((F.col("period") == 1).cast("long")).alias("n1")).filter("n0 > 0 and n1 > 0")
    v = values.groupBy(by, "value").agg(F.sum((F.col("period") == 0).cast("long")).alias("c0"), F.sum((F.col("period") == 1).cast("long")).alias("c1")).join(sizes, by)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumns({"f0": F.sum("c0").over(upto) / F.col("n0"), "f1": F.sum("c1").over(upto) / F.col("n1"), "width": F.lead("value").over(w) - F.col("value")})
    return v.groupBy(by).agg(F.sum(F.abs(F.col("f0") - F.col("f1")) * F.coalesce("width", F.lit(0.0))).alias("w1"))


def tier_changes(memories: DataFrame, *, as_of: Column | int, promote_score: float = 0.5, demote_days: int = 30, archive_days: int = 90, hot_cap: int = 100) -> DataFrame:
    """fiber_id, brain_id, from_tier, to_tier: warm memories with the best scores rise while a brain's hot tier has room; idle ones fall a tier; pinned ones never fall."""
    idle = F.greatest(F.lit(0), F.lit(as_of) - F.col("last_day"))
    score = formulas.promotion_score(idle.cast("double"), F.col("frequency"), F.col("salience"), F.col("frequency"))
    hot = memories.groupBy("brain_id").agg(F.sum((F.col("tier") == "hot").cast("long")).alias("hot"))
    up = memories.filter("tier = 'warm'").withColumn("score", score).filter(F.col("score") >= promote_score)
    turn = F.row_number().over(Window.partitionBy("brain_id").orderBy(F.round("score", 9).desc(), "fiber_id"))
    up = up.withColumn("turn", turn).join(hot, "brain_id").filter(F.col("turn") <= hot_cap - F.col("hot"))
    up = up.select("fiber_id", "brain_id", F.col("tier").alias("from_tier"), F.lit("hot").alias("to_tier"))
    down = memories.filter(~F.col("pinned") & (((F.col("tier") == "hot") & (idle >= demote_days)) | ((F.col("tier") == "warm") & (idle >= archive_days))))
    down = down.select("fiber_id", "brain_id", F.col("tier").alias("from_tier"), F.when(F.col("tier") == "hot", "warm").otherwise("cold").alias("to_tier"))
    return up.unionByName(down.join(up.select("fiber_id"), "fiber_id", "left_anti"))


def reinforce(states: DataFrame, accesses: DataFrame, *, delta: float = 0.05) -> DataFrame:
    """id, activation_level, access_frequency after a log of accesses (id, one row each): the closed form of so many steps."""
    n = accesses.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    return states.join(n, "id").select("id", F.least(F.lit(1.0), F.col("activation_level") + delta * F.col("times")).alias("activation_level"), (F.col("access_frequency") + F.col("times")).alias("access_frequency"))


def replay(synapses: DataFrame, members: DataFrame, *, ltp: float = 1.1, ltd: float = 0.98, floor: float = 0.01) -> DataFrame:
    """id, weight after replaying episodes (fiber_id, neuron_id): an edge inside an episode grows, one that leaves it shrinks, once for each episode."""
    source = members.select(F.col("neuron_id").alias("source_id"), "fiber_id")
    touched = synapses.select("id", "source_id", "target_id", "weight").join(source, "source_id")
    inside = touched.join(members.select(F.col("neuron_id").alias("target_id"), "fiber_id", F.lit(1).alias("inside")), ["target_id", "fiber_id"], "left")
    n = inside.groupBy("id", "weight").agg(F.sum(F.coalesce("inside", F.lit(0))).alias("up"), F.sum(1 - F.coalesce("inside", F.lit(0))).alias("down"))
    return n.select("id", F.least(F.lit(1.0), F.greatest(F.lit(floor), F.col("weight") * F.pow(F.lit(ltp), F.col("up")) * F.pow(F.lit(ltd), F.col("down")))).alias("weight"))


def drifting_tags(pairs: DataFrame, counts: DataFrame, *, thresholds: Sequence[float] = (0.3, 0.4, 0.7), support: int = 3) -> DataFrame:
    """tag_a, tag_b, jaccard, verdict (review, alias, merge) of tags that mostly stand together."""
    c = lambda side: counts.select(F.col("tag").alias(f"tag_{side}"), F.col("cnt").alias(f"n{side}"))
    j = pairs.filter(F.col("cnt") >= support).join(c("a"), "tag_a").join(c("b"), "tag_b")
    j = j.withColumn("jaccard", F.col("cnt") / (F.col("na") + F.col("nb") - F.col("cnt"))).filter(F.col("jaccard") >= thresholds[0])
    return j.select("tag_a", "tag_b", "jaccard", F.when(F.col("jaccard") >= thresholds[2], "merge").when(F.col("jaccard") >= thresholds[1], "alias").otherwise("review").alias("verdict"))
