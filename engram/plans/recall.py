"""Queries of stop rules, mixed activation, greedy budgets, explanations and supplements of recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.fixtures import Tables, oracle
from engram.operators import graph, recall
from engram.plans.memory import _PATH, _SPREAD, pathways, top_customers
from engram.plans.registry import register

_HOPS = """, f0 AS (SELECT q, count(*) AS n FROM h0 GROUP BY q), n1 AS (SELECT q, node FROM h1 WHERE (q, node) NOT IN (SELECT q, node FROM h0)), f1 AS (SELECT q, count(*) AS n FROM n1 GROUP BY q),
n2 AS (SELECT q, node FROM h2 WHERE (q, node) NOT IN (SELECT q, node FROM h0) AND (q, node) NOT IN (SELECT q, node FROM h1)), f2 AS (SELECT q, count(*) AS n FROM n2 GROUP BY q),
f AS (SELECT f0.q, f0.n AS a, coalesce(f1.n, 0) AS b, coalesce(f2.n, 0) AS c FROM f0 LEFT JOIN f1 USING (q) LEFT JOIN f2 USING (q))"""


def trace(t: Tables) -> DataFrame:
    """query_id, hop, n: nodes first reached in each hop."""
    edges = graph.walkable(t.synapses())
    one = graph.spread(top_customers(t), edges, max_hops=1, min_level=0.1).select("query_id", "node_id", F.when(F.col("hop") == 0, 0).otherwise(1).alias("hop"))
    first = top_customers(t).select("query_id", "node_id", F.lit(0).alias("hop")).unionByName(one)
    two = graph.spread(top_customers(t), edges, max_hops=2, min_level=0.1).select("query_id", "node_id", F.lit(2).alias("hop"))
    every = first.unionByName(two).groupBy("query_id", "node_id").agg(F.min("hop").alias("hop"))
    return every.groupBy("query_id", "hop").agg(F.count(F.lit(1)).alias("n"))


@register("gr2_stop_rule", oracle("SELECT q AS query_id, CASE WHEN b < 2 OR b / a < 0.5 THEN 2 WHEN c < 2 OR (b > 0 AND c / b < 0.5) THEN 3 ELSE 4 END AS stop FROM f", _SPREAD + _HOPS))
def gr2(spark: SparkSession, sf: str) -> DataFrame:
    return recall.stop_rule(trace(Tables(spark, sf)), ratio=0.5)


@register(
    "gr2_gated_spread",
    oracle(
        """SELECT q AS query_id, node AS node_id, round(max(level), 6) AS level FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT h2.* FROM h2 JOIN f USING (q) WHERE b >= 2 AND b / a >= 100) GROUP BY 1, 2""",
        _SPREAD + _HOPS,
    ),
)
def gr2_gated(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    out = graph.spread(top_customers(t), graph.walkable(t.synapses()), max_hops=2, min_level=0.1, stop=(100.0, 2, 1))
    return out.select("query_id", "node_id", F.round("level", 6).alias("level"))


@register(
    "gr5_hybrid",
    oracle(
        """SELECT query_id, node_id, round(max(level), 6) AS level FROM (
    SELECT q AS query_id, y.node_id, pow(0.85 * y.conductivity, abs(y.position - x.position)) AS level FROM h0 JOIN way x ON x.node_id = node JOIN way y ON y.fiber_id = x.fiber_id WHERE pow(0.85 * y.conductivity, abs(y.position - x.position)) >= 0.05
    UNION ALL SELECT query_id, node_id, 0.6 * level FROM reached) GROUP BY 1, 2""",
        _SPREAD + ", " + _PATH,
    ),
)
def gr5(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return recall.hybrid(top_customers(t), graph.walkable(t.synapses()), pathways(t)).withColumn("level", F.round("level", 6))


@register(
    "rk16_greedy_budget",
    oracle(
        "SELECT anchor, unnest(ids) AS id, unnest(sums) AS used FROM (SELECT anchor, ids, sums FROM run WHERE i = len(l) + 1 AND len(ids) > 0)",
        """l AS (SELECT anchor, list({'id': id, 't': CAST(10 + 13 * frequency AS INTEGER)} ORDER BY round(salience / (10 + 13 * frequency), 9) DESC, id) AS l FROM fibers GROUP BY anchor),
    run AS (SELECT anchor, l, 1 AS i, CAST(0 AS INTEGER) AS used, CAST([] AS VARCHAR[]) AS ids, CAST([] AS INTEGER[]) AS sums FROM l UNION ALL
      SELECT anchor, l, i + 1, CASE WHEN used + l[i].t <= 400 THEN used + l[i].t ELSE used END, CASE WHEN used + l[i].t <= 400 THEN list_append(ids, l[i].id) ELSE ids END, CASE WHEN used + l[i].t <= 400 THEN list_append(sums, used + l[i].t) ELSE sums END FROM run WHERE i <= len(l))""",
    ).replace("WITH neurons AS", "WITH RECURSIVE neurons AS", 1),
)
def rk16_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return recall.greedy_budget(Tables(spark, sf).fibers(), by="anchor", value=F.col("salience"), tokens=10 + 13 * F.col("frequency"), budget=400)


_EACH = """anchor AS (SELECT brain_id AS q, id AS src FROM (SELECT brain_id, id, row_number() OVER (PARTITION BY brain_id ORDER BY access_frequency DESC, id) AS r FROM neuron_states WHERE id LIKE 'c:%') WHERE r <= 3),
g0 AS (SELECT q, src, src AS node, 1.0::DOUBLE AS level FROM anchor), g1 AS (SELECT q, src, t AS node, max(level * 0.5 * f) AS level FROM g0 JOIN edge ON s = node GROUP BY ALL HAVING max(level * 0.5 * f) >= 0.1),
g2 AS (SELECT q, src, t AS node, max(level * 0.5 * f) AS level FROM g1 JOIN edge ON s = node GROUP BY ALL HAVING max(level * 0.5 * f) >= 0.1),
every AS (SELECT q, node, max(level) AS level, count(DISTINCT src) AS sources FROM (SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2) GROUP BY 1, 2),
ranked AS (SELECT q, node, sources > 1 AS boosted, level * CASE WHEN sources > 1 THEN 1.5 ELSE 1.0 END AS score, row_number() OVER (PARTITION BY q ORDER BY round(level * CASE WHEN sources > 1 THEN 1.5 ELSE 1.0 END, 9) DESC, node) AS r FROM every)"""


@register("rk27_explain", oracle("SELECT q AS query_id, node AS node_id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score, boosted, CASE WHEN max(score) OVER (PARTITION BY q) > 0.8 THEN 'single' ELSE 'multi' END AS method FROM ranked WHERE r <= 5", _SPREAD + ", " + _EACH))
def rk27(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    a = top_customers(t)
    each = graph.spread(a.select(F.concat_ws("|", "query_id", "node_id").alias("query_id"), "node_id", "level"), graph.walkable(t.synapses()), max_hops=2, min_level=0.1)
    each = each.select(F.split("query_id", r"\|")[0].alias("query_id"), F.split("query_id", r"\|")[1].alias("source"), "node_id", "level")
    return recall.explain(each).withColumn("score", F.round("score", 6))


@register("rk19_chunks")
def rk19(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    edges = graph.walkable(t.synapses())
    found = graph.spread(top_customers(t), edges, max_hops=2, min_level=0.1)
    return recall.chunk_results(found, edges.withColumnRenamed("factor", "weight"))


@register(
    "gr10_causal_supplement",
    oracle(
        """SELECT query_id, node_id, CAST(depth AS INTEGER) AS depth, round(confidence, 6) AS confidence, used FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY query_id ORDER BY round(confidence, 9) DESC, depth, node_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
    FROM (SELECT query_id, node_id, arg_max(depth, (round(confidence, 9), -depth)) AS depth, max(confidence) AS confidence FROM hit GROUP BY 1, 2) JOIN (SELECT id AS node_id, length(content) AS size FROM neurons) USING (node_id)) WHERE used <= 200""",
        """sel AS (SELECT fiber_id AS query_id, neuron_id AS node_id FROM fiber_neurons JOIN fibers ON id = fiber_id WHERE pinned AND neuron_id LIKE 'p:%'),
    lead AS (SELECT source_id AS s, target_id AS t, max(weight) AS w FROM synapses WHERE type = 'LEADS_TO' GROUP BY 1, 2),
    c1 AS (SELECT DISTINCT node_id AS seed, t AS node, w AS w1 FROM sel JOIN lead ON s = node_id WHERE t <> node_id),
    c2 AS (SELECT seed, t AS node, max(w1 * w) AS w2 FROM c1 JOIN lead ON s = node WHERE t <> seed AND (seed, t) NOT IN (SELECT seed, node FROM c1) GROUP BY 1, 2),
    chain AS (SELECT seed, node, 1 AS depth, w1 AS confidence FROM c1 UNION ALL SELECT seed, node, 2, sqrt(w2) FROM c2),
    hit AS (SELECT query_id, node AS node_id, depth, confidence FROM sel JOIN chain ON seed = sel.node_id WHERE (query_id, node) NOT IN (SELECT query_id, node_id FROM sel))""",
    ),
)
def gr10(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    pinned = t.fibers().filter("pinned").select(F.col("id").alias("fiber_id"))
    sel = t.fiber_neurons().join(pinned, "fiber_id").filter(F.col("neuron_id").startswith("p:")).select(F.col("fiber_id").alias("query_id"), F.col("neuron_id").alias("node_id"))
    chains = graph.causal_chain(sel.select("node_id").distinct(), t.synapses(), max_depth=2).filter("depth > 0")
    texts = t.neurons().select(F.col("id").alias("node_id"), F.length("content").cast("long").alias("size"))
    return recall.causal_supplement(sel, chains.select("seed", "node_id", "depth", "confidence"), texts, chars=200).withColumn("confidence", F.round("confidence", 6))
