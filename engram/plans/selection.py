"""Queries of the filter, join and aggregate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.fixtures import Tables, oracle
from engram.operators import aggregates, filters, joins, setjoin
from engram.plans.registry import register

HUBS = "p:1,p:2,p:3,c:1,c:2,n:1,n:2,s:1".split(",")
_HUB_SQL = ", ".join(f"('{h}')" for h in HUBS)


def frontier(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in HUBS], "node_id string")


@register("flt1_find_neurons", oracle("SELECT id, brain_id, content FROM neurons WHERE type = 'CONCEPT' AND contains(lower(content), 'ring')"))
def flt1(spark: SparkSession, sf: str) -> DataFrame:
    return filters.find_neurons(Tables(spark, sf).neurons(), type="CONCEPT", contains="RING").select("id", "brain_id", "content")


@register(
    "flt2_find_fibers",
    oracle("""SELECT id, round(salience, 6) AS salience FROM fibers f WHERE salience >= 0.2 AND created_day <= 10000 AND end_day >= 9500
    AND id IN (SELECT fiber_id FROM fiber_neurons WHERE neuron_id LIKE 'p:%') AND (SELECT count(DISTINCT tag) FROM fiber_tags t WHERE t.fiber_id = f.id AND tag IN ('building', 'brand#7')) >= 2"""),
)
def flt2(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return filters.find_fibers(t.fibers(), t.fiber_neurons(), t.fiber_tags(), overlaps=(9500, 10000), with_tags=["Building", "Brand#7"], min_salience=0.2).select("id", F.round("salience", 6).alias("salience"))


@register("flt2_fibers_of_neuron", oracle("SELECT f.id, round(salience, 6) AS salience FROM fibers f JOIN fiber_neurons b ON b.fiber_id = f.id AND neuron_id = 'p:1'"))
def flt2_member(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return filters.find_fibers(t.fibers(), t.fiber_neurons(), t.fiber_tags(), contains_neuron="p:1").select("id", F.round("salience", 6).alias("salience"))


@register("flt3_typed_memories", oracle("SELECT fiber_id, priority, tier FROM typed_memories, order_as_of WHERE memory_type = 'decision' AND tier = 'cold' AND priority >= 5 AND (expires_day IS NULL OR expires_day > as_of)"))
def flt3(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return filters.find_typed_memories(t.typed_memories(), type="decision", tier="cold", min_priority=5, as_of=t.order_as_of()).select("fiber_id", "priority", "tier")


@register("flt4_expired", oracle("SELECT brain_id, memory_type, count(*) AS cnt FROM typed_memories, order_as_of WHERE expires_day <= as_of GROUP BY ALL"))
def flt4(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return aggregates.count_by(filters.expired(t.typed_memories(), t.order_as_of()), "brain_id", "memory_type")


@register("flt5_expiring_within", oracle("SELECT fiber_id, expires_day FROM typed_memories, order_as_of WHERE expires_day > as_of AND expires_day <= as_of + 14"))
def flt5(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return filters.expiring_within(t.typed_memories(), t.order_as_of(), 14).select("fiber_id", "expires_day")


@register("flt6_valid_at", oracle("SELECT id, brain_id FROM fibers WHERE created_day <= 10000 AND end_day >= 10000"))
def flt6(spark: SparkSession, sf: str) -> DataFrame:
    return filters.valid_at(Tables(spark, sf).fibers(), 10000, "created_day", "end_day").select("id", "brain_id")


@register("flt8_promotion_candidates", oracle("SELECT id AS fiber_id, frequency, round(conductivity, 6) AS conductivity FROM fibers f JOIN typed_memories m ON m.fiber_id = f.id WHERE memory_type = 'context' AND NOT m.pinned AND frequency >= 5"))
def flt8(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return filters.promotion_candidates(t.typed_memories(), t.fibers()).withColumn("conductivity", F.round("conductivity", 6))


@register("flt10_pinned_neurons", oracle("SELECT DISTINCT b.brain_id, neuron_id FROM fiber_neurons b JOIN fibers f ON f.id = fiber_id WHERE pinned"))
def flt10(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return filters.pinned_neurons(t.fibers(), t.fiber_neurons())


@register(
    "flt11_subgraph",
    oracle(
        "SELECT e.id FROM synapses e WHERE source_id IN (SELECT neuron_id FROM kept) AND target_id IN (SELECT neuron_id FROM kept)",
        "kept AS (SELECT DISTINCT neuron_id FROM fiber_neurons JOIN fibers f ON f.id = fiber_id WHERE salience >= 0.95)",
    ),
)
def flt11(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return filters.extract_subgraph(t.fibers(), t.fiber_neurons(), t.synapses(), min_salience=0.95)[2].select("id")


@register("flt12_stale_fibers", oracle("SELECT brain_id, count(*) AS cnt FROM fibers, order_as_of WHERE NOT pinned AND as_of - end_day >= 90 GROUP BY brain_id"))
def flt12(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return aggregates.count_by(filters.stale_fibers(t.fibers(), t.order_as_of(), 90), "brain_id")


@register(
    "jn1_neighbors",
    oracle(
        """SELECT source_id AS node_id, target_id AS neighbor_id, id AS edge_id, type, round(weight, 6) AS weight FROM synapses WHERE weight >= 0.3 AND source_id IN (SELECT h FROM hubs)
    UNION ALL SELECT target_id, source_id, id, type, round(weight, 6) FROM synapses WHERE weight >= 0.3 AND target_id IN (SELECT h FROM hubs) AND source_id <> target_id""",
        f"hubs AS (SELECT * FROM (VALUES {_HUB_SQL}) AS t(h))",
    ),
)
def jn1(spark: SparkSession, sf: str) -> DataFrame:
    return joins.neighbors(frontier(spark), Tables(spark, sf).synapses(), min_weight=0.3).withColumn("weight", F.round("weight", 6))


@register(
    "jn1_neighbors_in",
    oracle("SELECT target_id AS node_id, source_id AS neighbor_id, id AS edge_id FROM synapses WHERE type IN ('CO_OCCURS', 'RELATED_TO', 'SIMILAR_TO', 'NEAR', 'USED_WITH') AND target_id IN (SELECT h FROM hubs)", f"hubs AS (SELECT * FROM (VALUES {_HUB_SQL}) AS t(h))"),
)
def jn1_in(spark: SparkSession, sf: str) -> DataFrame:
    return joins.neighbors(frontier(spark), Tables(spark, sf).synapses(), direction="in").select("node_id", "neighbor_id", "edge_id")


@register("jn2_synapses_for", oracle("SELECT type, count(*) AS cnt FROM synapses WHERE target_id IN (SELECT h FROM hubs) GROUP BY type", f"hubs AS (SELECT * FROM (VALUES {_HUB_SQL}) AS t(h))"))
def jn2(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.count_by(joins.synapses_for(frontier(spark), Tables(spark, sf).synapses(), direction="in"), "type")


@register(
    "jn3_fibers_for_neurons",
    oracle("""SELECT DISTINCT fiber_id, round(salience, 6) AS salience FROM (SELECT fiber_id, salience, row_number() OVER (PARTITION BY neuron_id ORDER BY salience DESC, fiber_id) AS r
    FROM fiber_neurons JOIN fibers f ON f.id = fiber_id) WHERE r <= 3"""),
)
def jn3(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    nodes = t.neurons().select(F.col("id").alias("node_id"))
    return joins.fibers_for_neurons(nodes, t.fiber_neurons(), t.fibers(), limit_per_neuron=3).withColumn("salience", F.round("salience", 6))


@register(
    "jn5_temporal_binding",
    oracle("""SELECT brain_id, fiber_id, anchor, target_id, round(greatest(0.1, 0.4 * (1 - gap / 3)), 6) AS weight FROM (
    SELECT a.brain_id, a.id AS fiber_id, a.anchor, b.anchor AS target_id, a.created_day - b.created_day AS gap, row_number() OVER (PARTITION BY a.id ORDER BY b.created_day DESC, b.id) AS r
    FROM fibers a JOIN fibers b ON a.brain_id = b.brain_id AND b.created_day BETWEEN a.created_day - 3 AND a.created_day AND a.anchor <> b.anchor) WHERE r <= 3"""),
)
def jn5(spark: SparkSession, sf: str) -> DataFrame:
    return joins.temporal_binding(Tables(spark, sf).fibers(), window=3).withColumn("weight", F.round("weight", 6))


@register("jn6_temporal_range", oracle("SELECT id, created_day, end_day FROM fibers WHERE created_day <= 9600 AND end_day >= 9500"))
def jn6(spark: SparkSession, sf: str) -> DataFrame:
    return joins.temporal_range(Tables(spark, sf).fibers(), 9500, 9600).select("id", "created_day", "end_day")


@register(
    "jn7_fiber_overlap",
    oracle(
        "SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN s x ON x.fiber_id = a JOIN s y ON y.fiber_id = b WHERE shared / (x.n + y.n - shared) >= 0.33",
        """s AS (SELECT fiber_id, count(*) AS n FROM fiber_neurons GROUP BY 1),
    p AS (SELECT x.fiber_id AS a, y.fiber_id AS b, count(*) AS shared FROM fiber_neurons x JOIN fiber_neurons y ON x.neuron_id = y.neuron_id AND x.fiber_id < y.fiber_id GROUP BY 1, 2)""",
    ),
)
def jn7(spark: SparkSession, sf: str) -> DataFrame:
    return setjoin.overlap_pairs(Tables(spark, sf).fiber_neurons(), key="neuron_id", min_jaccard=0.33).withColumn("jaccard", F.round("jaccard", 6))


@register(
    "jn8_tag_overlap",
    oracle(
        "SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN s x ON x.fiber_id = a JOIN s y ON y.fiber_id = b WHERE shared / (x.n + y.n - shared) >= 0.45",
        """k AS (SELECT fiber_id, tag FROM fiber_tags WHERE origin = 'auto'), s AS (SELECT fiber_id, count(*) AS n FROM k GROUP BY 1),
    p AS (SELECT x.fiber_id AS a, y.fiber_id AS b, count(*) AS shared FROM k x JOIN k y ON x.tag = y.tag AND x.fiber_id < y.fiber_id GROUP BY 1, 2)""",
    ),
)
def jn8(spark: SparkSession, sf: str) -> DataFrame:
    topics = Tables(spark, sf).fiber_tags().filter("origin = 'auto'")
    return setjoin.overlap_pairs(topics, key="tag", min_jaccard=0.45).withColumn("jaccard", F.round("jaccard", 6))


@register(
    "jn11_cooccur_within",
    oracle("""SELECT least(x.action, y.action) AS a, greatest(x.action, y.action) AS b, count(*) AS n FROM acts x JOIN acts y ON x.session_id = y.session_id AND x.action <> y.action
    AND abs(x.at_us - y.at_us) <= 21600000000 AND (y.at_us < x.at_us OR (y.at_us = x.at_us AND y.id < x.id)) GROUP BY 1, 2"""),
)
def jn11(spark: SparkSession, sf: str) -> DataFrame:
    return joins.cooccur_within(Tables(spark, sf).events(), window_us=21_600_000_000, key=F.col("action"))


@register(
    "jn12_entity_cooccurrence",
    oracle("SELECT x.neuron_id AS a, y.neuron_id AS b, count(*) AS cnt FROM fiber_neurons x JOIN fiber_neurons y ON x.fiber_id = y.fiber_id AND x.neuron_id < y.neuron_id WHERE x.neuron_id LIKE 'p:%' AND y.neuron_id LIKE 'p:%' GROUP BY 1, 2 HAVING count(*) >= 2"),
)
def jn12(spark: SparkSession, sf: str) -> DataFrame:
    parts = Tables(spark, sf).fiber_neurons().filter(F.col("neuron_id").startswith("p:")).select("fiber_id", F.col("neuron_id").alias("tag"))
    return aggregates.tag_cooccurrence(parts).filter("cnt >= 2").select(F.col("tag_a").alias("a"), F.col("tag_b").alias("b"), "cnt")


@register("ag1_brain_stats", oracle("SELECT brain_id, (SELECT count(*) FROM neurons n WHERE n.brain_id = b.brain_id) AS neurons, (SELECT count(*) FROM synapses s WHERE s.brain_id = b.brain_id) AS synapses, (SELECT count(*) FROM fibers f WHERE f.brain_id = b.brain_id) AS fibers FROM (SELECT DISTINCT brain_id FROM neurons) b"))
def ag1(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return aggregates.brain_stats(t.neurons(), t.synapses(), t.fibers())


@register("ag2_synapse_stats_by_type", oracle("SELECT brain_id, type, count(*) AS cnt, round(avg(weight), 6) AS avg_weight, CAST(sum(reinforced_count) AS BIGINT) AS reinforcements FROM synapses GROUP BY ROLLUP (brain_id, type) HAVING brain_id IS NOT NULL"))
def ag2(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.synapse_stats_by_type(Tables(spark, sf).synapses()).withColumn("avg_weight", F.round("avg_weight", 6))


@register("ag3_neuron_types", oracle("SELECT brain_id, type, count(*) AS cnt FROM neurons GROUP BY ALL"))
def ag3(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.count_by(Tables(spark, sf).neurons(), "brain_id", "type")


@register("ag3_memory_tiers", oracle("SELECT memory_type, tier, count(*) AS cnt FROM typed_memories, order_as_of WHERE expires_day IS NULL OR expires_day > as_of GROUP BY ALL"))
def ag3_tiers(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return aggregates.count_by(filters.find_typed_memories(t.typed_memories(), as_of=t.order_as_of()), "memory_type", "tier")


@register("ag4_co_activation_counts", oracle("SELECT a, b, count(*) AS cnt, round(avg(strength), 6) AS avg_strength FROM brand_pairs, order_as_of WHERE day >= as_of - 60 GROUP BY a, b HAVING count(*) >= 3"))
def ag4(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return aggregates.co_activation_counts(t.co_activations("brand"), since=t.order_as_of() - 60, min_count=3).withColumn("avg_strength", F.round("avg_strength", 6))


@register("ag5_tag_cooccurrence", oracle("SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS cnt FROM fiber_tags x JOIN fiber_tags y ON x.fiber_id = y.fiber_id AND x.tag < y.tag WHERE x.origin = 'agent' AND y.origin = 'agent' GROUP BY 1, 2"))
def ag5(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.tag_cooccurrence(Tables(spark, sf).fiber_tags().filter("origin = 'agent'"))


@register("ag6_tag_fiber_counts", oracle("SELECT tag, count(DISTINCT fiber_id) AS cnt FROM fiber_tags GROUP BY tag"))
def ag6(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.tag_fiber_counts(Tables(spark, sf).fiber_tags())


@register(
    "ag7_keyword_idf",
    oracle("""SELECT tag AS keyword, count(DISTINCT fiber_id) AS df, round(ln((n + 1) / (1 + count(DISTINCT fiber_id))) / ln(n + 1), 6) AS idf,
    CAST(greatest(1, least(5, ceil(ln((n + 1) / (1 + count(DISTINCT fiber_id))) / ln(n + 1) * 5))) AS INTEGER) AS anchor_limit FROM fiber_tags, (SELECT count(*) AS n FROM fibers) GROUP BY tag, n"""),
)
def ag7(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    total = t.fibers().agg(F.count(F.lit(1)).alias("n"))
    return aggregates.keyword_idf(t.fiber_tags().select("fiber_id", F.col("tag").alias("keyword")), total).withColumn("idf", F.round("idf", 6))


@register("ag8_tool_stats", oracle("SELECT action, server, count(*) AS cnt, round(avg(success::INTEGER), 2) AS success_rate, round(avg(duration_ms), 9) AS avg_ms FROM acts GROUP BY action, server ORDER BY cnt DESC, action, server LIMIT 20"))
def ag8(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.tool_stats(Tables(spark, sf).events(), by=["action", "server"], top=20).withColumn("avg_ms", F.round("avg_ms", 9))


@register("ag9_tool_stats_daily", oracle("SELECT day, action, count(*) AS cnt, round(avg(success::INTEGER), 2) AS success_rate, round(avg(duration_ms), 9) AS avg_ms FROM acts GROUP BY day, action"))
def ag9(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.tool_stats(Tables(spark, sf).events(), by=["day", "action"]).withColumn("avg_ms", F.round("avg_ms", 9))


@register("ag10_change_log_stats", oracle("SELECT l_returnflag AS flag, count(*) AS total, count(*) FILTER (l_discount > 0.05) AS large, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY 1"))
def ag10(spark: SparkSession, sf: str) -> DataFrame:
    li = Tables(spark, sf).read("lineitem").withColumnRenamed("l_returnflag", "flag")
    return aggregates.conditional_counts(li, "flag", large=F.col("l_discount") > 0.05, open=F.col("l_linestatus") == "O")


@register("ag11_graph_density", oracle("SELECT n.brain_id, round(coalesce(e, 0) / c, 6) AS density FROM (SELECT brain_id, count(*) AS c FROM neurons GROUP BY 1) n LEFT JOIN (SELECT brain_id, count(*) AS e FROM synapses GROUP BY 1) s USING (brain_id)"))
def ag11(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return aggregates.graph_density(t.neurons(), t.synapses()).withColumn("density", F.round("density", 6))


@register(
    "ag12_freshness_report",
    oracle("""SELECT brain_id, count(*) FILTER (age < 7) AS fresh, count(*) FILTER (age >= 7 AND age < 30) AS recent, count(*) FILTER (age >= 30 AND age < 90) AS aging, count(*) FILTER (age >= 90 AND age < 365) AS stale,
    count(*) FILTER (age >= 365) AS ancient, round(avg(age), 6) AS avg_age, min(age) AS min_age, max(age) AS max_age FROM (SELECT brain_id, CAST(as_of - created_day AS DOUBLE) AS age FROM fibers, order_as_of) GROUP BY brain_id"""),
)
def ag12(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return aggregates.freshness_report(t.fibers(), F.lit(t.order_as_of()) - F.col("created_day")).withColumn("avg_age", F.round("avg_age", 6))


@register("ag13_fan_effect", oracle("SELECT tag, count(DISTINCT fiber_id) AS cnt FROM fiber_tags GROUP BY tag HAVING count(DISTINCT fiber_id) > 60"))
def ag13(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.fan_effect(Tables(spark, sf).fiber_tags(), threshold=60)
