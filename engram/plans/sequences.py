"""Queries of the window, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.fixtures import Tables, oracle
from engram.operators import sets, topk, windows
from engram.plans.registry import register

WINDOW = 21_600_000_000
_PAIRS = """steps AS (SELECT action AS a, lead(action) OVER w AS b, (lead(at_us) OVER w - at_us) / 1e6 AS gap FROM acts WINDOW w AS (PARTITION BY session_id ORDER BY at_us, id)),
pairs AS (SELECT a, b, count(*) AS cnt, avg(gap) AS avg_gap FROM steps WHERE b IS NOT NULL AND gap <= 21600 GROUP BY a, b)"""


@register("wn1_sequential_pairs", oracle("SELECT a, b, cnt, round(avg_gap, 4) AS avg_gap FROM pairs", _PAIRS))
def wn1(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sequential_pairs(Tables(spark, sf).events(), window_us=WINDOW).withColumn("avg_gap", F.round("avg_gap", 4))


@register(
    "wn2_habit_candidates",
    oracle(
        """SELECT steps, frequency, round(duration, 3) AS duration, round(frequency / s, 6) AS confidence FROM (
    SELECT a || '>' || b AS steps, cnt AS frequency, avg_gap AS duration FROM pairs WHERE cnt >= 150
    UNION ALL SELECT x.a || '>' || x.b || '>' || y.b, least(x.cnt, y.cnt), x.avg_gap + y.avg_gap FROM pairs x JOIN pairs y ON x.b = y.a AND y.b <> x.a WHERE x.cnt >= 150 AND y.cnt >= 150), (SELECT count(DISTINCT session_id) AS s FROM acts)""",
        _PAIRS,
    ),
)
def wn2(spark: SparkSession, sf: str) -> DataFrame:
    e = Tables(spark, sf).events()
    sessions = e.agg(F.countDistinct("session_id")).head()[0]
    out = windows.habit_candidates(windows.sequential_pairs(e, window_us=WINDOW), F.lit(sessions), min_frequency=150)
    return out.select("steps", "frequency", F.round("duration", 3).alias("duration"), F.round("confidence", 6).alias("confidence"))


@register(
    "wn4_gate_ema",
    oracle(
        """SELECT gate, round(sum(CASE WHEN k = last THEN pow(1 - 2.0 / 21, k) ELSE 2.0 / 21 * pow(1 - 2.0 / 21, k) END * v), 6) AS ema, count(*) AS n
    FROM (SELECT *, max(k) OVER (PARTITION BY gate) AS last FROM c WHERE k < 20) GROUP BY gate""",
        """c AS (SELECT source AS gate, CAST((quality = 1) = (doc_id % 100 >= 30) AS INTEGER) AS v, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS k FROM labels JOIN documents USING (doc_id))""",
    ),
)
def wn4(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    rows = t.read("labels").join(t.read("documents").select("doc_id", F.col("source").alias("gate")), "doc_id")
    right = ((F.col("quality") == 1) == (F.col("doc_id") % 100 >= 30)).cast("int")
    return windows.ema(rows, by="gate", order=[F.col("doc_id")], value=right, window=20).withColumn("ema", F.round("ema", 6))


@register("wn8_cap_log", oracle("SELECT id, session_id, rank FROM (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY at_us DESC, id DESC) AS rank FROM acts) WHERE rank <= 5"))
def wn8(spark: SparkSession, sf: str) -> DataFrame:
    return windows.per_group_topk(Tables(spark, sf).events(), keys=["session_id"], order=[F.col("at_us").desc(), F.col("id").desc()], k=5).select("id", "session_id", "rank")


@register("wn11_latest_per_key", oracle("SELECT session_id, action, id FROM acts QUALIFY row_number() OVER (PARTITION BY session_id, action ORDER BY at_us DESC, id DESC) = 1"))
def wn11(spark: SparkSession, sf: str) -> DataFrame:
    return windows.latest_per_key(Tables(spark, sf).events(), keys=["session_id", "action"], order=[F.col("at_us"), F.col("id")]).select("session_id", "action", "id")


@register(
    "st2_sessionize",
    oracle(
        'SELECT session_id, CAST(part AS BIGINT) AS part, min(at_us) AS "begin", max(at_us) AS "end", count(*) AS events FROM p GROUP BY session_id, part',
        """n AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER w > 21600000000 OR lag(at_us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM acts WINDOW w AS (PARTITION BY session_id ORDER BY at_us, id)),
    p AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY at_us, id ROWS UNBOUNDED PRECEDING) AS part FROM n)""",
    ),
)
def st2(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessionize(Tables(spark, sf).events(), gap_us=WINDOW)


@register("tk1_hot_neurons", oracle("SELECT id, access_frequency, round(activation_level, 6) AS activation_level FROM neuron_states ORDER BY access_frequency DESC, id LIMIT 10"))
def tk1(spark: SparkSession, sf: str) -> DataFrame:
    return topk.hot_neurons(Tables(spark, sf).neuron_states()).select("id", "access_frequency", F.round("activation_level", 6).alias("activation_level"))


@register(
    "tk2_suggest",
    oracle("""SELECT id, content, round(t + 0.1 * access_frequency + 0.5 * activation_level, 6) AS score FROM (SELECT n.id, content, CASE WHEN starts_with(lower(content), 'red') THEN 1.0 WHEN contains(lower(content), 'red') THEN 0.5 END AS t,
    access_frequency, activation_level FROM neurons n JOIN neuron_states s ON s.id = n.id) WHERE t IS NOT NULL ORDER BY t + 0.1 * access_frequency + 0.5 * activation_level DESC, id LIMIT 10"""),
)
def tk2(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return topk.suggest(t.neurons(), t.neuron_states(), "Red").withColumn("score", F.round("score", 6))


@register(
    "tk4_knn",
    """SELECT query_id, node_id, round(sim, 6) AS sim, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS node_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 5""",
)
def tk4(spark: SparkSession, sf: str) -> DataFrame:
    v = Tables(spark, sf).read("embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    queries = v.filter("node_id % 20 = 0").withColumnRenamed("node_id", "query_id")
    return topk.knn(v, queries, 5).withColumn("sim", F.round("sim", 6))


_HALF = "half AS (SELECT CAST(quantile_disc(created_day, 0.5) AS INTEGER) AS mid FROM fibers)"


@register("set1_snapshot_diff", oracle("SELECT id, CASE WHEN created_day >= mid THEN 'added' ELSE 'modified' END AS change FROM fibers, half WHERE created_day >= mid OR end_day >= mid", _HALF))
def set1(spark: SparkSession, sf: str) -> DataFrame:
    f = Tables(spark, sf).fibers()
    mid = f.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY created_day)")).head()[0]
    old = f.filter(F.col("created_day") < mid).withColumn("end_day", F.least(F.col("end_day"), F.lit(mid - 1)))
    return sets.snapshot_diff(old, f, key="id", values=["end_day", "frequency"])


_ACT = """act AS (SELECT brain_id AS query_id, anchor_set, neuron_id AS node_id, round(max(salience), 6) AS level, min(frequency) AS hop FROM (SELECT f.brain_id, CAST(left(priority, 1) AS INTEGER) AS anchor_set, neuron_id, salience, frequency
    FROM fibers f JOIN fiber_neurons b ON b.fiber_id = f.id WHERE salience >= 0.9) GROUP BY ALL)"""


def anchored(t: Tables) -> DataFrame:
    f = t.fibers().filter("salience >= 0.9").select(F.col("id").alias("fiber_id"), F.col("brain_id").alias("query_id"), F.substring("priority", 1, 1).cast("int").alias("anchor_set"), "salience", "frequency")
    both = f.join(t.fiber_neurons().select("fiber_id", F.col("neuron_id").alias("node_id")), "fiber_id")
    return both.groupBy("query_id", "anchor_set", "node_id").agg(F.round(F.max("salience"), 6).alias("level"), F.min("frequency").alias("hop"))


@register("set2_intersect_activations", oracle("SELECT query_id, node_id, count(DISTINCT anchor_set) AS sets, round(sum(level), 6) AS total FROM act GROUP BY 1, 2 HAVING count(DISTINCT anchor_set) >= 2", _ACT))
def set2(spark: SparkSession, sf: str) -> DataFrame:
    return sets.intersect_activations(anchored(Tables(spark, sf))).withColumn("total", F.round("total", 6))


@register(
    "set3_combine_anchor_sets",
    oracle("SELECT query_id, node_id, round(list_reduce(levels, lambda a, x: least(1.0, a + 0.5 * x)), 6) AS level, hop FROM (SELECT query_id, node_id, list(level ORDER BY anchor_set) AS levels, min(hop) AS hop FROM act GROUP BY 1, 2)", _ACT),
)
def set3(spark: SparkSession, sf: str) -> DataFrame:
    return sets.combine_anchor_sets(anchored(Tables(spark, sf))).withColumn("level", F.round("level", 6))


_AB = _ACT + ", a AS (SELECT query_id, node_id, level FROM act WHERE anchor_set = 1), b AS (SELECT query_id, node_id, level FROM act WHERE anchor_set = 2)"


@register(
    "set4_fuzzy_boolean",
    oracle(
        """SELECT 'and' AS op, query_id, node_id, round(a.level * b.level, 6) AS score FROM a JOIN b USING (query_id, node_id)
    UNION ALL SELECT 'or', query_id, node_id, round(coalesce(a.level, 0) + coalesce(b.level, 0) - coalesce(a.level, 0) * coalesce(b.level, 0), 6) FROM a FULL JOIN b USING (query_id, node_id)
    UNION ALL SELECT 'not', query_id, node_id, round(a.level * (1 - coalesce(b.level, 0)), 6) FROM a LEFT JOIN b USING (query_id, node_id)""",
        _AB,
    ),
)
def set4(spark: SparkSession, sf: str) -> DataFrame:
    act = anchored(Tables(spark, sf))
    a, b = (act.filter(F.col("anchor_set") == i).select("query_id", "node_id", F.col("level").alias("score")) for i in (1, 2))
    parts = [df.select(F.lit(op).alias("op"), "query_id", "node_id", F.round("score", 6).alias("score")) for op, df in (("and", sets.fuzzy_and(a, b)), ("or", sets.fuzzy_or(a, b)), ("not", sets.fuzzy_not(a, b)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
