"""Queries of evidence, reviews, topics and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.fixtures import Tables, oracle
from engram.operators import cognition, filters, topk
from engram.operators.dedup import exact_dedup
from engram.plans.registry import register
from engram.plans.sequences import WINDOW

_STEP = """greatest(0.01, least(0.99, c + CASE WHEN (e[i]).sign > 0 THEN 1 ELSE -1 END * greatest(0.1, least(1.0, (e[i]).weight)) * CASE WHEN (e[i]).sign > 0 THEN 1 - c ELSE c END / (1 + 0.1 * (i - 1)) * 0.3))"""
_RECURSIVE = lambda sql: sql.replace("WITH neurons AS", "WITH RECURSIVE neurons AS", 1)


@register(
    "sc18_confidence_fold",
    _RECURSIVE(
        oracle(
            "SELECT id, round(c, 6) AS confidence, len(e) AS evidence FROM run WHERE i = len(e) + 1",
            f"""ev AS (SELECT session_id AS id, list({{'sign': CASE WHEN success THEN 1 ELSE -1 END, 'weight': duration_ms / 100}} ORDER BY at_us, id) AS e FROM acts GROUP BY session_id),
    run AS (SELECT id, e, 1 AS i, 0.5::DOUBLE AS c FROM ev UNION ALL SELECT id, e, i + 1, {_STEP} FROM run WHERE i <= len(e))""",
        )
    ),
)
def sc18(spark: SparkSession, sf: str) -> DataFrame:
    e = Tables(spark, sf).events()
    ev = e.select(F.col("session_id").alias("id"), F.col("at_us").alias("at"), F.col("id").alias("seq"), F.when(F.col("success"), 1).otherwise(-1).alias("sign"), (F.col("duration_ms") / 100).alias("weight"))
    return cognition.confidence_fold(ev).withColumn("confidence", F.round("confidence", 6))


@register(
    "sc23_review_replay",
    _RECURSIVE(
        oracle(
            "SELECT item, box, streak, round(ease, 4) AS ease, round(days, 6) AS days FROM run WHERE i = len(r) + 1",
            """rv AS (SELECT session_id AS item, list({'ok': success, 'q': CASE WHEN success THEN CAST(id % 6 AS INTEGER) ELSE CAST(least(id % 6, 2) AS INTEGER) END} ORDER BY at_us, id) AS r FROM acts GROUP BY session_id),
    run AS (SELECT item, r, 1 AS i, 1 AS box, 0 AS streak, 2.5::DOUBLE AS ease, 1.0::DOUBLE AS days FROM rv UNION ALL
      SELECT item, r, i + 1, nb, CASE WHEN ok THEN streak + 1 ELSE 0 END, ne, ([1.0, 3.0, 7.0, 14.0, 30.0])[nb] * CASE WHEN nb > 2 AND ok THEN ne ELSE 1.0 END FROM (
        SELECT *, (r[i]).ok AS ok, CASE WHEN (r[i]).ok THEN least(box + 1, 5) ELSE greatest(1, box - CASE WHEN box <= 3 THEN 1 ELSE 2 END) END AS nb,
          round(greatest(1.3, least(3.0, ease + 0.1::DOUBLE - (5 - (r[i]).q) * (0.08::DOUBLE + (5 - (r[i]).q) * 0.02::DOUBLE))), 4) AS ne FROM run WHERE i <= len(r)))""",
        )
    ),
)
def sc23(spark: SparkSession, sf: str) -> DataFrame:
    e = Tables(spark, sf).events()
    r = e.select(F.col("session_id").alias("item"), F.col("at_us").alias("at"), F.col("id").alias("seq"), F.col("success").alias("ok"), (F.col("id") % 6).cast("int").alias("quality"))
    return cognition.review_replay(r).select("item", "box", "streak", F.round("ease", 4).alias("ease"), F.round("days", 6).alias("days"))


@register(
    "tk6_hot_index",
    oracle(
        """SELECT id, kind, round(score, 6) AS score FROM (SELECT id, 'hypothesis' AS kind, 3 * (1 - 2 * abs(salience - 0.5)) + 4 * least(frequency / 5, 1.0) + 3 / (1 + (as_of - created_day) / 30) AS score FROM fibers, order_as_of WHERE as_of - created_day <= 200
    UNION ALL SELECT id, 'prediction', CASE WHEN end_day < as_of THEN 10.0 ELSE 10 / (1 + (end_day - as_of) / 3) END FROM fibers, order_as_of WHERE as_of - created_day <= 200 AND pinned)"""
    ),
)
def tk6(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    as_of = t.order_as_of()
    f = t.fibers().filter(F.lit(as_of) - F.col("created_day") <= 200)
    h = f.select("id", F.lit("hypothesis").alias("kind"), cognition.hypothesis_score(F.col("salience"), F.col("frequency"), F.lit(as_of) - F.col("created_day")).alias("score"))
    p = f.filter("pinned").select("id", F.lit("prediction").alias("kind"), cognition.prediction_score(F.col("end_day") - F.lit(as_of)).alias("score"))
    return h.unionByName(p).withColumn("score", F.round("score", 6))


@register(
    "wn6_topic_ema",
    _RECURSIVE(
        oracle(
            "SELECT session_id, topic, round(w, 6) AS weight FROM run WHERE i = steps AND w > 0",
            """q AS (SELECT session_id, action AS topic, row_number() OVER (PARTITION BY session_id ORDER BY at_us, id) - 1 AS n FROM acts),
    tot AS (SELECT session_id, max(n) + 1 AS steps FROM q GROUP BY 1), seen AS (SELECT session_id, topic, list(n) AS at_n, any_value(steps) AS steps FROM q JOIN tot USING (session_id) GROUP BY 1, 2),
    run AS (SELECT session_id, topic, at_n, steps, 0::BIGINT AS i, 0.0::DOUBLE AS w FROM seen UNION ALL
      SELECT session_id, topic, at_n, steps, i + 1, CASE WHEN w * 0.7::DOUBLE < 0.01 THEN 0.0 ELSE w * 0.7::DOUBLE END + CASE WHEN list_contains(at_n, i) THEN 0.3::DOUBLE ELSE 0.0 END FROM run WHERE i < steps)""",
        )
    ),
)
def wn6(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("session_id").orderBy("at_us", "id")) - 1
    q = Tables(spark, sf).events().select("session_id", n.alias("n"), F.col("action").alias("topic"))
    return cognition.topic_ema(q).withColumn("weight", F.round("weight", 6))


@register(
    "wn3_query_topic_pairs",
    oracle(
        "SELECT topic_a, topic_b, count(*) AS cnt FROM (SELECT unnest(t) AS topic_a, nx FROM n WHERE gap <= 21600000000), unnest(nx) AS u(topic_b) WHERE topic_a <> topic_b GROUP BY 1, 2",
        "n AS (SELECT [action, task] AS t, lead([action, task]) OVER w AS nx, lead(at_us) OVER w - at_us AS gap FROM acts WINDOW w AS (PARTITION BY session_id ORDER BY at_us, id))",
    ),
)
def wn3(spark: SparkSession, sf: str) -> DataFrame:
    return cognition.query_topic_pairs(Tables(spark, sf).events().withColumn("topics", F.array("action", "task")), window_us=WINDOW)


@register(
    "rk16_within_budget",
    oracle(
        "SELECT id, brain_id, used FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY brain_id ORDER BY round(salience / tokens, 9) DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM (SELECT id, brain_id, salience, 10 + 13 * frequency AS tokens FROM fibers)) WHERE used <= 5000"
    ),
)
def rk16(spark: SparkSession, sf: str) -> DataFrame:
    return cognition.within_budget(Tables(spark, sf).fibers(), by="brain_id", value=F.col("salience"), tokens=10 + 13 * F.col("frequency"), budget=5000).select("id", "brain_id", "used")


@register(
    "rk20_recall_confidence",
    oracle(
        """SELECT id, round(greatest(0.0, least(1.0, 0.35 * salience + 0.25 * conductivity + 0.2 * least(1.0, frequency / 10) + 0.2 / (1 + (as_of - created_day) / 30) - CASE WHEN pinned THEN 0.3 ELSE 0 END)), 4) AS confidence FROM fibers, order_as_of"""
    ),
)
def rk20(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    age = F.lit(t.order_as_of()) - F.col("created_day")
    return t.fibers().select("id", cognition.recall_confidence(F.col("salience"), F.col("conductivity"), F.least(F.lit(1.0), F.col("frequency") / 10), age, F.col("pinned")).alias("confidence"))


@register(
    "qh3_evolution",
    oracle(
        "SELECT brain_id, round(avg(CASE WHEN age <= 7 THEN 1.0 ELSE 0 END), 6) AS activity, round(avg(1 / (1 + exp((age - 30) / 10))), 6) AS vitality, round(avg(CASE WHEN frequency > 0 THEN 1.0 ELSE 0 END), 6) AS used FROM (SELECT *, greatest(0, as_of - end_day) AS age FROM fibers, order_as_of) GROUP BY 1"
    ),
)
def qh3(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return cognition.evolution(t.fibers(), as_of=t.order_as_of()).select("brain_id", *[F.round(c, 6).alias(c) for c in ("activity", "vitality", "used")])


@register(
    "qh10_data_points",
    r"SELECT doc_id, CAST(regexp_extract(p, '^[0-9.]+') AS DOUBLE) AS value, regexp_extract(p, '[^0-9.]+$') AS unit FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)?(?:%|ms|kg|km)')) AS p FROM documents)",
)
def qh10(spark: SparkSession, sf: str) -> DataFrame:
    return cognition.data_points(Tables(spark, sf).read("documents"))


@register("cn18_schema_candidates", oracle("SELECT tag, count(DISTINCT fiber_id) AS cnt FROM fiber_tags WHERE origin = 'auto' GROUP BY 1 HAVING count(DISTINCT fiber_id) >= 10 ORDER BY cnt DESC, tag LIMIT 20"))
def cn18(spark: SparkSession, sf: str) -> DataFrame:
    return cognition.schema_candidates(Tables(spark, sf).fiber_tags().filter("origin = 'auto'"))


@register(
    "cn20_reconsolidate",
    oracle(
        """SELECT query_id, fiber_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, fiber_id) AS r FROM (SELECT f.anchor AS query_id, t.fiber_id, 1 - len(list_intersect(tags, ['building', 'brand#7', '5-low'])) / len(list_distinct(list_concat(tags, ['building', 'brand#7', '5-low']))) AS d
    FROM (SELECT fiber_id, list(DISTINCT tag) AS tags FROM fiber_tags WHERE origin = 'agent' GROUP BY 1) t JOIN fibers f ON f.id = t.fiber_id) WHERE d > 0.6) WHERE r <= 3"""
    ),
)
def cn20(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    wanted = F.array(*map(F.lit, ("building", "brand#7", "5-low")))
    q = t.fibers().select(F.col("anchor").alias("query_id"), F.col("id").alias("fiber_id"), wanted.alias("query_tags"))
    return cognition.reconsolidate(q, t.fiber_tags().filter("origin = 'agent'")).withColumn("distance", F.round("distance", 6))


@register(
    "cn22_dirty_since",
    oracle(
        "SELECT fiber_id FROM dirty UNION SELECT fiber_id FROM fiber_neurons WHERE neuron_id IN (SELECT neuron_id FROM fiber_neurons WHERE fiber_id IN (SELECT fiber_id FROM dirty))",
        "dirty AS (SELECT id AS fiber_id FROM fibers, order_as_of WHERE created_day > as_of - 3)",
    ),
)
def cn22(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    changes = t.fibers().select(F.col("id").alias("fiber_id"), F.col("created_day").alias("sequence"))
    return cognition.dirty_since(changes, t.fiber_neurons(), after=t.order_as_of() - 3)


@register(
    "dd18_heading_hierarchy",
    r"""SELECT DISTINCT array_to_string(p[1 : i - 1], ' > ') AS parent, array_to_string(p[1 : i], ' > ') AS child, 0.9::DOUBLE AS weight FROM
    (SELECT list_filter(string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages), unnest(range(2, len(p) + 1)) AS u(i)""",
)
def dd18(spark: SparkSession, sf: str) -> DataFrame:
    path = F.filter(F.split(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "/"), lambda x: x != "")
    return cognition.heading_hierarchy(Tables(spark, sf).read("pages").select(path.alias("heading_path")).filter(F.size("heading_path") > 0))


@register("dd3_dedup_benchmark", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id FROM documents")
def dd3(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(Tables(spark, sf).read("documents"), keys=[F.sha2(F.col("text").cast("binary"), 256)], id="doc_id")


@register(
    "jn10_vector_pairs",
    "SELECT a.vec_id AS query_id, b.vec_id AS node_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4",
)
def jn10(spark: SparkSession, sf: str) -> DataFrame:
    v = Tables(spark, sf).read("embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    return topk.similar_pairs(v, 0.4).withColumn("sim", F.round("sim", 6))


@register("tk3_rank_by", oracle("SELECT id, row_number() OVER (ORDER BY last_day DESC, id) AS rank FROM neuron_states WHERE last_day IS NOT NULL ORDER BY rank LIMIT 50"))
def tk3(spark: SparkSession, sf: str) -> DataFrame:
    return topk.rank_by(Tables(spark, sf).neuron_states().filter("last_day is not null"), F.col("last_day"), 50)


@register("flt7_status_in", oracle("SELECT id FROM fibers WHERE status IN ('O', 'P') AND anchor IN (SELECT id FROM neuron_states WHERE access_frequency >= 12)"))
def flt7(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    active = t.neuron_states().filter("access_frequency >= 12").select(F.col("id").alias("anchor"))
    return filters.status_in(t.fibers(), active, ("O", "P")).select("id")


@register("flt9_scope_match", oracle("SELECT fiber_id, round(CASE WHEN as_of - created_day <= 30 THEN 1.2::DOUBLE ELSE 1.0 END * CASE WHEN priority >= 7 THEN 1.1::DOUBLE ELSE 1.0 END, 6) AS boost FROM typed_memories, order_as_of WHERE tier <> 'cold'"))
def flt9(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return filters.scope_boost(t.typed_memories().filter("tier <> 'cold'"), as_of=t.order_as_of(), window_days=30).select("fiber_id", F.round("boost", 6).alias("boost"))
