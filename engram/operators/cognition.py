"""Evidence, reviews, topics of sessions, budgets and plans of attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days until the next review, by box 1 to 5.
REVIEW_DAYS = (1, 3, 7, 14, 30)


def confidence_fold(evidence: DataFrame, *, start: float = 0.5) -> DataFrame:
    """id, confidence: evidence (id, at, seq, sign +1 or -1, weight) in order, each moving confidence by its surprise and less the more came before; within 0.01..0.99."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "seq", "sign", "weight")))
    begin = F.struct(F.lit(start).alias("c"), F.lit(0).alias("n"))

    def step(acc: Column, e: Column) -> Column:
        weight = F.greatest(F.lit(0.1), F.least(F.lit(1.0), e["weight"]))
        surprise = F.when(e["sign"] > 0, 1 - acc["c"]).otherwise(acc["c"])
        c = acc["c"] + e["sign"] * weight * surprise / (1 + 0.1 * acc["n"]) * 0.3
        return F.struct(F.greatest(F.lit(0.01), F.least(F.lit(0.99), c)).alias("c"), (acc["n"] + 1).alias("n"))

    folded = evidence.groupBy("id").agg(ordered.alias("e"))
    return folded.select("id", F.aggregate("e", begin, step, lambda acc: acc["c"]).alias("confidence"), F.size("e").alias("evidence"))


def hypothesis_score(confidence: Column, evidence: Column, age_days: Column) -> Column:
    return 3 * (1 - 2 * F.abs(confidence - 0.5)) + 4 * F.least(evidence / 5, F.lit(1.0)) + 3 / (1 + age_days / 30)


def prediction_score(days_left: Column) -> Column:
    return F.when(days_left < 0, 10.0).otherwise(10 / (1 + F.greatest(days_left, F.lit(0)) / 3))


def review_replay(reviews: DataFrame) -> DataFrame:
    """item, box, streak, ease, interval after all reviews (item, at, seq, ok, quality) in order: boxes of growing intervals with an ease factor."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "seq", "ok", "quality")))
    begin = F.struct(F.lit(1).alias("box"), F.lit(0).alias("streak"), F.lit(2.5).alias("ease"), F.lit(1.0).alias("days"))
    intervals = F.array(*[F.lit(float(d)) for d in REVIEW_DAYS])

    def step(acc: Column, r: Column) -> Column:
        q = F.greatest(F.lit(0), F.least(F.lit(5), F.when(r["ok"], r["quality"]).otherwise(F.least(r["quality"], F.lit(2)))))
        ease = F.round(F.greatest(F.lit(1.3), F.least(F.lit(3.0), acc["ease"] + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))), 4)
        box = F.when(r["ok"], F.least(acc["box"] + 1, F.lit(len(REVIEW_DAYS)))).otherwise(F.greatest(F.lit(1), acc["box"] - F.when(acc["box"] <= 3, 1).otherwise(2)))
        days = F.element_at(intervals, box) * F.when((box > 2) & r["ok"], ease).otherwise(1.0)
        return F.struct(box.alias("box"), F.when(r["ok"], acc["streak"] + 1).otherwise(0).alias("streak"), ease.alias("ease"), days.alias("days"))

    return reviews.groupBy("item").agg(ordered.alias("r")).select("item", F.aggregate("r", begin, step).alias("s")).select("item", "s.*")


def topic_ema(queries: DataFrame, *, alpha: float = 0.3, least: float = 0.01) -> DataFrame:
    """session_id, topic, weight: each query (session_id, n from 0, topic) fades all topics of its session and raises its own; a topic below `least` is forgotten."""
    total = queries.groupBy("session_id").agg((F.max("n") + 1).alias("steps"))
    seen = queries.groupBy("session_id", "topic").agg(F.collect_set("n").alias("at")).join(total, "session_id")

    def step(w: Column, i: Column) -> Column:
        faded = w * (1 - alpha)
        return F.when(faded < least, 0.0).otherwise(faded) + F.when(F.array_contains("at", i), alpha).otherwise(0.0)

    weight = F.aggregate(F.sequence(F.lit(0), F.col("steps") - 1), F.lit(0.0), step)
    return seen.select("session_id", "topic", weight.alias("weight")).filter("weight > 0")


def query_topic_pairs(events: DataFrame, *, window_us: int) -> DataFrame:
    """topic_a, topic_b, cnt: topics of a recall and of the next one in its session. events: session_id, id, at_us, topics."""
    w = Window.partitionBy("session_id").orderBy("at_us", "id")
    e = events.select("topics", F.lead("topics").over(w).alias("next"), (F.lead("at_us").over(w) - F.col("at_us")).alias("gap")).filter(F.col("gap") <= window_us)
    pairs = e.select(F.explode("topics").alias("topic_a"), "next").select("topic_a", F.explode("next").alias("topic_b")).filter("topic_a <> topic_b")
    return pairs.groupBy("topic_a", "topic_b").agg(F.count(F.lit(1)).alias("cnt"))


def within_budget(items: DataFrame, *, by: str, value: Column, tokens: Column, budget: int) -> DataFrame:
    """The rows of each group that fit its budget, taken by value for each token (the prefix form: it ends at the first that does not fit)."""
    t = items.withColumns({"tokens": tokens, "density": value / tokens})
    used = F.sum("tokens").over(Window.partitionBy(by).orderBy(F.round("density", 9).desc(), "id").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("used", used).filter(F.col("used") <= budget).drop("density")


def recall_confidence(retrieval: Column, quality: Column, fidelity: Column, age_days: Column, familiar: Column) -> Column:
    fresh = F.when(age_days.isNull(), 0.5).otherwise(1 / (1 + age_days / 30))
    raw = 0.35 * retrieval + 0.25 * quality + 0.2 * fidelity + 0.2 * fresh - F.when(familiar, 0.3).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def evolution(fibers: DataFrame, *, as_of: int) -> DataFrame:
    """brain_id, active share and mean decay (a sigmoid around 30 days) of fibers."""
    age = F.greatest(F.lit(0), F.lit(as_of) - F.col("end_day"))
    return fibers.groupBy("brain_id").agg(F.avg((age <= 7).cast("double")).alias("activity"), F.avg(1 / (1 + F.exp((age - 30) / 10))).alias("vitality"), F.avg((F.col("frequency") > 0).cast("double")).alias("used"))


def data_points(texts: DataFrame) -> DataFrame:
    """doc_id, value, unit of numbers with a unit in a text."""
    found = F.regexp_extract_all("text", F.lit(r"\b[0-9]+(?:\.[0-9]+)?(?:%|ms|kg|km)"), F.lit(0))
    p = texts.select("doc_id", F.explode(found).alias("p"))
    return p.select("doc_id", F.regexp_extract("p", r"^[0-9.]+", 0).cast("double").alias("value"), F.regexp_extract("p", r"[^0-9.]+$", 0).alias("unit"))


def schema_candidates(tags: DataFrame, *, least: int = 10, top: int = 20) -> DataFrame:
    """Tags on enough fibers to become a schema, the largest first."""
    return tags.groupBy("tag").agg(F.countDistinct("fiber_id").alias("cnt")).filter(F.col("cnt") >= least).orderBy(F.col("cnt").desc(), "tag").limit(top)


def reconsolidate(queries: DataFrame, tags: DataFrame, *, drift: float = 0.6, most: int = 3) -> DataFrame:
    """query_id, fiber_id, distance: recalled fibers (query_id, fiber_id, query_tags) whose tags differ much from the query's; the nearest few of each query."""
    t = tags.groupBy("fiber_id").agg(F.collect_set("tag").alias("tags"))
    d = queries.join(t, "fiber_id").withColumn("distance", 1 - F.size(F.array_intersect("query_tags", "tags")) / F.size(F.array_union("query_tags", "tags"))).filter(F.col("distance") > drift)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "fiber_id"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= most).select("query_id", "fiber_id", "distance")


def dirty_since(changes: DataFrame, bridge: DataFrame, *, after: int) -> DataFrame:
    """fiber_id of fibers changed after a watermark, and of those that share a node with them: what incremental consolidation looks at."""
    own = changes.filter(F.col("sequence") > after).select("fiber_id").distinct()
    nodes = bridge.join(own, "fiber_id", "left_semi").select("neuron_id").distinct()
    return bridge.join(nodes, "neuron_id", "left_semi").select("fiber_id").union(own).distinct()


def heading_hierarchy(chunks: DataFrame) -> DataFrame:
    """parent, child, weight: CONTAINS edges between heading paths (arrays), each once."""
    paths = chunks.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("heading_path")), lambda i: F.slice("heading_path", 1, i))).alias("path")).distinct()
    return paths.filter(F.size("path") > 1).select(F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), " > ").alias("parent"), F.array_join("path", " > ").alias("child"), F.lit(0.9).alias("weight"))
