"""Queries of diverse selection, views of the past, versions and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.fixtures import Tables, oracle
from engram.operators import health, ranking, selection, windows
from engram.plans.memory import _HEALTH, _WORDS, bm25_sql, reached
from engram.plans.registry import register
from engram.plans.sequences import _PAIRS, WINDOW


@register("rk12_diverse")
def rk12(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    scored = ranking.fiber_score(reached(t), t.fiber_neurons(), t.fibers(), as_of=t.order_as_of(), keep=50)
    return selection.diverse(scored.drop("rank"), t.fiber_neurons()).withColumn("score", F.round("score", 9))


@register("rk25_as_of_view", oracle("SELECT id, least(end_day, 10000) AS end_day FROM fibers WHERE created_day <= 10000"))
def rk25(spark: SparkSession, sf: str) -> DataFrame:
    return selection.as_of_view(Tables(spark, sf).fibers(), 10000).select("id", "end_day")


_SUMMARY = bm25_sql(f"SELECT l_orderkey AS doc_id, {_WORDS.format('p_name')} FROM lineitem JOIN part ON p_partkey = l_partkey", "SELECT r_regionkey AS query_id, unnest(['red', 'widget', 'small']) AS term FROM region")


@register("rk26_summary_search", "WITH " + _SUMMARY + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10")
def rk26(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    words = F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("term")
    docs = t.read("lineitem").join(t.read("part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("doc_id"), words)
    queries = t.read("region").select(F.col("r_regionkey").alias("query_id"), F.explode(F.array(*map(F.lit, ("red", "widget", "small")))).alias("term"))
    return ranking.bm25(docs, queries).withColumn("score", F.round("score", 6))


@register("cn12_habit_edges", oracle("SELECT a AS source, b AS target, round(least(1.0, cnt / s), 6) AS weight FROM pairs, (SELECT count(DISTINCT session_id) AS s FROM acts) WHERE cnt >= 150", _PAIRS))
def cn12(spark: SparkSession, sf: str) -> DataFrame:
    e = Tables(spark, sf).events()
    n = e.agg(F.countDistinct("session_id")).head()[0]
    return selection.habit_edges(windows.sequential_pairs(e, window_us=WINDOW), sessions=n, min_frequency=150).withColumn("weight", F.round("weight", 6))


@register("cn24_reactivate_dormant")
def cn24(spark: SparkSession, sf: str) -> DataFrame:
    return selection.reactivate_dormant(Tables(spark, sf).neuron_states(), seed=24)


@register("gr9_event_sequence", oracle("SELECT anchor, id AS fiber_id, position FROM (SELECT anchor, id, row_number() OVER (PARTITION BY anchor ORDER BY created_day, id) AS position FROM fibers) WHERE position <= 5"))
def gr9(spark: SparkSession, sf: str) -> DataFrame:
    return selection.event_sequence(Tables(spark, sf).fibers(), most=5)


@register(
    "sc24_quantize",
    "SELECT vec_id, round(step, 9) AS step, CAST(list_sum(codes) AS BIGINT) AS total FROM (SELECT vec_id, step, list_transform(embedding, lambda x: round((x::DOUBLE - lo) / step)) AS codes FROM (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS lo, greatest((list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) / 255, 1e-12) AS step FROM embeddings))",
)
def sc24(spark: SparkSession, sf: str) -> DataFrame:
    codes, _, step = selection.quantize_int8(F.col("embedding"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x)
    return Tables(spark, sf).read("embeddings").select("vec_id", F.round(step, 9).alias("step"), total.alias("total"))


@register(
    "cn23_consolidation_delta",
    oracle(
        """SELECT brain_id, 'connectivity' AS metric, round(b, 6) AS "before", round(a, 6) AS "after", round(a - b, 6) AS delta FROM (SELECT brain_id, 1 / (1 + exp(-1.5 * (coalesce(e, 0) / n - 3))) AS b, 1 / (1 + exp(-1.5 * (coalesce(e2, 0) / n - 3))) AS a FROM n LEFT JOIN s USING (brain_id) LEFT JOIN (SELECT brain_id, count(*) AS e2 FROM synapses WHERE weight >= 0.5 GROUP BY 1) USING (brain_id))""",
        _HEALTH,
    ),
)
def cn23(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    n, e, s, f, as_of = t.neurons(), t.synapses(), t.neuron_states(), t.fibers(), t.order_as_of()
    before, after = (health.health(n, x, s, f, as_of=as_of) for x in (e, e.filter("weight >= 0.5")))
    out = selection.consolidation_delta(before, after, ["connectivity"])
    return out.select("brain_id", "metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


@register(
    "sc25_expand_terms",
    "SELECT DISTINCT query_id, term FROM (SELECT c_custkey AS query_id, lower(c_mktsegment) AS term FROM customer UNION ALL SELECT c_custkey, s.e FROM customer JOIN (VALUES ('building', 'house'), ('building', 'tower'), ('machinery', 'engine')) AS s(t, e) ON t = lower(c_mktsegment))",
)
def sc25(spark: SparkSession, sf: str) -> DataFrame:
    q = Tables(spark, sf).read("customer").select(F.col("c_custkey").alias("query_id"), F.lower("c_mktsegment").alias("term"))
    synonyms = spark.createDataFrame([("building", "house"), ("building", "tower"), ("machinery", "engine")], "term string, expansion string")
    return selection.expand_terms(q, F.broadcast(synonyms))  # three rows


def _quality_sql() -> str:
    from engram.functions import text

    c = lambda p: f"CAST(regexp_matches(text, '{p}') AS INTEGER)"
    specific = " OR ".join(f"regexp_matches(text, '{p.removesuffix('(?<!' + chr(92) + '.' + chr(92) + 'w' + chr(92) + '.)')}')" for p in text.SPECIFIC)
    points = f"greatest(0, least(10, CAST(n >= 10 AS INTEGER) + CAST(n >= 50 AS INTEGER) + CAST(turn > 0 AS INTEGER) + CAST(role <> 'fact' AS INTEGER) + {c(text.CAUSAL)} + {c(text.TEMPORAL)} + {c(text.COMPARATIVE)} + CAST({specific} AS INTEGER) + {c(text.STRUCTURE)} + CAST(n BETWEEN 50 AND 300 AS INTEGER) - 2 * CAST(n > 500 AS INTEGER)))"
    return f"SELECT conv_id, turn, points, CASE WHEN points >= 7 THEN 'high' WHEN points >= 4 THEN 'medium' ELSE 'low' END AS label FROM (SELECT conv_id, turn, {points} AS points FROM (SELECT *, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM conversations))"


@register("sc19_quality_points", _quality_sql())
def sc19(spark: SparkSession, sf: str) -> DataFrame:
    from engram.functions import text

    points = text.quality_points(F.col("text"), F.col("role"), F.col("turn") > 0, F.lit(False))
    return Tables(spark, sf).read("conversations").select("conv_id", "turn", points.alias("points")).withColumn("label", text.quality_label(F.col("points")))
