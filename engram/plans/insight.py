"""Queries of drift, surfaces, life cycles, pulses and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.fixtures import Tables, oracle
from engram.functions import formulas
from engram.operators import dedup, insight, links
from engram.plans.memory import _HASHES, hashed
from engram.plans.registry import register
from engram.plans.signals import q

_TOPICS = """ses AS (SELECT DISTINCT c_nationkey AS n, o_orderkey AS s, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS tm, p_brand AS topic FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
lastses AS (SELECT *, count(*) OVER (PARTITION BY n) AS many FROM (SELECT n, s, row_number() OVER (PARTITION BY n ORDER BY max(tm) DESC, s DESC) AS place FROM ses GROUP BY n, s) WHERE place <= 20),
cnt AS (SELECT n, topic, count(*) FILTER (place > many // 2) AS before, count(*) FILTER (place <= many // 2) AS after FROM ses JOIN lastses USING (n, s) WHERE many >= 4 GROUP BY 1, 2)"""


@register(
    "wn10_temporal_drift",
    f"""WITH {_TOPICS} SELECT 'n:' || n AS brain_id, old_term, new_term, round(c, 2) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c DESC, old_term, new_term) AS r FROM
    (SELECT a.n, a.topic AS old_term, b.topic AS new_term, least(a.before, b.after) / greatest(a.before, b.after) AS c FROM cnt a JOIN cnt b ON a.n = b.n AND a.after = 0 AND a.before >= 2 AND b.before = 0 AND b.after >= 2) WHERE c >= 0.3) WHERE r <= 10""",
)
def wn10(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    o = t.read("orders").join(t.read("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t.read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.read("part"), F.col("p_partkey") == F.col("l_partkey"))
    return insight.temporal_drift(o.select(t.key("n", "c_nationkey").alias("brain_id"), F.col("o_orderkey").alias("session_id"), F.unix_date(F.col("o_orderdate").cast("date")).alias("at"), F.col("p_brand").alias("topic")))


_SURFACE = """outs AS (SELECT source_id AS id, count(*) AS n FROM synapses GROUP BY 1),
sn AS (SELECT brain_id, id, score, CAST(row_number() OVER (PARTITION BY brain_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM (SELECT s.brain_id, s.id, 0.4 * activation_level + 0.3 * coalesce(greatest(0.0, 1 - (as_of - created_day) / 90), 0.0) + 0.2 * least(1.0, coalesce(n, 0) / 10) + 0.05 AS score
  FROM neuron_states s JOIN neurons USING (id) CROSS JOIN order_as_of LEFT JOIN outs USING (id) WHERE type IN ('ENTITY', 'CONCEPT')) QUALIFY rank <= 30)"""


def surface(t: Tables) -> DataFrame:
    return insight.surface_nodes(t.neurons(), t.neuron_states(), t.synapses(), as_of=t.order_as_of())


@register("tk7_surface_nodes", oracle("SELECT brain_id, id, round(score, 6) AS score, rank FROM sn", _SURFACE))
def tk7(spark: SparkSession, sf: str) -> DataFrame:
    return surface(Tables(spark, sf)).withColumn("score", F.round("score", 6))


@register(
    "tk7_surface_edges",
    oracle("SELECT x.source_id AS id, x.type, x.target_id, coalesce(y.id IS NOT NULL, false) AS inside FROM (SELECT s.*, sn.brain_id AS brain, row_number() OVER (PARTITION BY s.source_id ORDER BY weight DESC, target_id, type) AS r FROM synapses s JOIN sn ON sn.id = s.source_id) x LEFT JOIN sn y ON y.id = x.target_id AND y.brain_id = x.brain WHERE r <= 5", _SURFACE),
)
def tk7_edges(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return insight.surface_edges(surface(t), t.synapses())


@register(
    "tk7_surface_clusters",
    oracle(
        "SELECT CAST(row_number() OVER (ORDER BY size DESC, component) AS INTEGER) AS cluster, size, ids FROM (SELECT component, count(*) AS size, array_to_string(list_sort(list(id ORDER BY id)[1:5]), ',') AS ids FROM comp GROUP BY 1 ORDER BY size DESC, component LIMIT 8)",
        _SURFACE
        + """, m AS (SELECT fiber_id, neuron_id FROM fiber_neurons WHERE neuron_id IN (SELECT id FROM sn)), st AS (SELECT fiber_id, min(neuron_id) AS a FROM m GROUP BY 1),
    bi AS (SELECT a, neuron_id AS b FROM st JOIN m USING (fiber_id) WHERE a <> neuron_id UNION SELECT neuron_id, a FROM st JOIN m USING (fiber_id) WHERE a <> neuron_id),
    reach AS (SELECT a AS id, a AS other FROM bi UNION SELECT r.id, bi.b FROM reach r JOIN bi ON bi.a = r.other), comp AS (SELECT id, min(other) AS component FROM reach GROUP BY 1)""",
    ).replace("WITH neurons AS", "WITH RECURSIVE neurons AS", 1),
)
def tk7_clusters(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return insight.surface_clusters(surface(t), t.fiber_neurons())


@register(
    "cn16_lifecycle",
    oracle(
        """SELECT id, CASE WHEN age < 7 THEN 'active' WHEN age < 30 OR heat >= 0.5 THEN 'warm' WHEN age < 90 THEN 'cool' WHEN age < 180 THEN 'compressed' ELSE 'archived' END AS state
    FROM (SELECT id, as_of - created_day AS age, 0.4 * exp(-(as_of - last_day) / 7) + 0.4 * least(1.0, access_frequency / 20) + 0.1 AS heat FROM neuron_states, order_as_of WHERE access_frequency > 0)"""
    ),
)
def cn16(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    s, as_of = t.neuron_states().filter("access_frequency > 0"), F.lit(t.order_as_of())
    heat = formulas.heat((as_of - F.col("last_day")).cast("double"), F.col("access_frequency").cast("double"), F.lit(5.0))
    return s.select("id", insight.lifecycle_state(as_of - F.col("created_day"), heat).alias("state"))


@register("cn16_fiber_lifecycle", oracle("SELECT id, false AS stale, age > 30 AS cold, age > 90 AS prune FROM (SELECT id, as_of - created_day AS age FROM fibers, order_as_of WHERE frequency = 0 AND NOT pinned) WHERE age > 30"))
def cn16_fibers(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return insight.fiber_lifecycle(t.fibers(), t.neurons().select("id", "content"), as_of=t.order_as_of())


@register(
    "qh5_health_pulse",
    oracle(
        f"""SELECT brain_id, round(con, 2) AS connectivity, round(orphans, 2) AS orphan_ratio,
    array_to_string(list_filter([CASE WHEN neurons > 2000 THEN 'prune:neurons' END, CASE WHEN fibers > 500 THEN 'merge:fibers' END, CASE WHEN synapses > 5000 THEN 'prune:synapses' END, CASE WHEN neurons >= 10 AND con < 1.5 THEN 'enrich:connectivity' END, CASE WHEN fibers >= 20 AND mature < 0.1 THEN 'mature:consolidation' END,
      CASE WHEN neurons >= 10 AND orphans > 0.25 THEN 'prune:orphans' END, CASE WHEN expired > 10 THEN 'prune:expired' END, CASE WHEN expiring > 0 THEN 'none:expiring' END, CASE WHEN fibers >= 10 AND old > 0.3 THEN 'prune:stale' END], lambda x: x IS NOT NULL), ',') AS hints,
    (['ok', 'low', 'medium', 'high', 'critical'])[1 + greatest(CASE WHEN neurons > 2000 OR fibers > 500 OR synapses > 5000 THEN 2 ELSE 0 END, CASE WHEN neurons >= 10 AND con < 1.5 THEN 1 ELSE 0 END, CASE WHEN fibers >= 20 AND mature < 0.02 THEN 3 WHEN fibers >= 20 AND mature < 0.1 THEN 2 ELSE 0 END,
      CASE WHEN neurons >= 10 AND orphans > 0.4 THEN 4 WHEN neurons >= 10 AND orphans > 0.25 THEN 2 ELSE 0 END, CASE WHEN expired > 10 OR expiring > 0 OR (fibers >= 10 AND old > 0.3) THEN 1 ELSE 0 END)] AS severity FROM p""",
        """ns AS (SELECT brain_id, count(*) AS neurons FROM neurons GROUP BY 1), ss AS (SELECT brain_id, count(*) AS synapses FROM synapses GROUP BY 1),
    fs AS (SELECT brain_id, count(*) AS fibers, count(*) FILTER (status = 'F') AS semantic, count(*) FILTER (as_of - end_day > 90) AS stale FROM fibers, order_as_of GROUP BY 1),
    ts AS (SELECT brain_id, count(*) FILTER (expires_day <= as_of) AS expired, count(*) FILTER (expires_day > as_of AND expires_day <= as_of + 7) AS expiring FROM typed_memories, order_as_of GROUP BY 1),
    p AS (SELECT *, synapses / neurons AS con, greatest(0.0, (neurons - 5 * fibers) / neurons) AS orphans, semantic / fibers AS mature, stale / fibers AS old FROM ns JOIN ss USING (brain_id) JOIN fs USING (brain_id) JOIN ts USING (brain_id))""",
    ),
)
def qh5(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    as_of, one = t.order_as_of(), F.count(F.lit(1))
    stats = t.neurons().groupBy("brain_id").agg(one.alias("neurons")).join(t.synapses().groupBy("brain_id").agg(one.alias("synapses")), "brain_id")
    stats = stats.join(t.fibers().groupBy("brain_id").agg(one.alias("fibers"), F.count_if(F.col("status") == "F").alias("semantic"), F.count_if(as_of - F.col("end_day") > 90).alias("stale")), "brain_id")
    due = F.col("expires_day")
    stats = stats.join(t.typed_memories().groupBy("brain_id").agg(F.count_if(due <= as_of).alias("expired"), F.count_if((due > as_of) & (due <= as_of + 7)).alias("expiring")), "brain_id")
    return insight.health_pulse(stats)


_CONFLICTS = f"""turns AS (SELECT 't:' || conv_id || ':' || turn AS id, conv_id, turn, lower(text) AS t FROM conversations WHERE text IS NOT NULL),
pairs AS (SELECT a.id, b.id AS other_id, a.t AS x, b.t AS y, (a.turn - b.turn) * 1800 AS gap FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 3 AND a.turn - 1),
words AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(x, {q(insight.NEGATION)}, '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains([{", ".join(map(q, insight.STOP))}], w))) AS a,
  list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(y, {q(insight.NEGATION)}, '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains([{", ".join(map(q, insight.STOP))}], w))) AS b FROM pairs WHERE regexp_matches(x, {q(insight.NEGATION)}) <> regexp_matches(y, {q(insight.NEGATION)})),
conflicts AS (SELECT id, other_id, len(list_intersect(a, b)) / least(len(a), len(b)) AS overlap, CASE WHEN gap < 3600 THEN 'same_session_correction' WHEN gap > 86400 THEN 'superseded' ELSE 'true_contradiction' END AS time_class FROM words WHERE len(a) > 0 AND len(b) > 0)"""


def turn_conflicts(t: Tables) -> DataFrame:
    """Turns against the three turns before them in their conversation."""
    c = t.read("conversations").filter("text is not null").select(F.concat(F.lit("t:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn", "text")
    later = c.select("id", "conv_id", "text", "turn", F.explode(F.array(*[F.col("turn") - i for i in (1, 2, 3)])).alias("at"))
    pairs = later.join(c.select(F.col("id").alias("other_id"), "conv_id", F.col("turn").alias("at"), F.col("text").alias("other_text")), ["conv_id", "at"])
    return insight.negation_conflicts(pairs.withColumn("gap_s", (F.col("turn") - F.col("at")) * 1800))


@register("dd13_negation_conflicts", f"WITH {_CONFLICTS} SELECT id, other_id, round(overlap, 6) AS overlap, round(least(1.0, 0.6 + 0.3 * overlap), 6) AS confidence, time_class FROM conflicts WHERE overlap >= 0.4")
def dd13(spark: SparkSession, sf: str) -> DataFrame:
    return turn_conflicts(Tables(spark, sf)).withColumn("overlap", F.round("overlap", 6)).withColumn("confidence", F.round("confidence", 6))


@register(
    "dd14_resolve_conflicts",
    f"WITH {_CONFLICTS} SELECT other_id AS id, 0.4::DOUBLE AS confidence, bool_or(time_class <> 'true_contradiction') AS superseded FROM conflicts WHERE overlap >= 0.4 GROUP BY other_id",
)
def dd14(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    known = t.read("conversations").select(F.concat(F.lit("t:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"), F.lit(0.8).alias("confidence")).distinct()
    return insight.resolve_conflicts(turn_conflicts(t), known)[0]


@register(
    "dd4_near_duplicate_clusters",
    "WITH RECURSIVE " + _HASHES + """, p AS (SELECT a.id AS a, b.id AS b FROM hashed a JOIN hashed b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 3), bi AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    reach AS (SELECT a AS id, a AS other FROM bi UNION SELECT r.id, bi.b FROM reach r JOIN bi ON bi.a = r.other) SELECT id, min(other) AS component FROM reach GROUP BY 1""",
)
def dd4(spark: SparkSession, sf: str) -> DataFrame:
    pairs, of = dedup.near_duplicate_classes(hashed(Tables(spark, sf)), joined=True)
    found = links.connected_components(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    return of.join(found.withColumnRenamed("id", "first"), "first", "left").select("id", F.coalesce("component", "first").alias("component"))
