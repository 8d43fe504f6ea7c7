"""Queries of links, penalties, clusters, text and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.fixtures import Tables, oracle
from engram.functions import text
from engram.operators import aggregates, anchors, joins, links, setjoin, sets, topk
from engram.operators.graph import walkable
from engram.plans.memory import _HASHES, _LISTS, _SPREAD, maturations, ranked_lists, reached
from engram.plans.registry import register
from engram.plans.sequences import _ACT, anchored
from engram.sources import files


@register(
    "jn13_cross_memory_links",
    oracle(
        """SELECT a, b, shared, round(least(0.7, 0.3 + 0.1 * (shared - 1)), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS r FROM
    (SELECT x.anchor AS a, y.anchor AS b, count(*) AS shared FROM m x JOIN m y ON x.neuron_id = y.neuron_id AND x.anchor < y.anchor GROUP BY 1, 2)) WHERE r <= 15""",
        "m AS (SELECT DISTINCT neuron_id, anchor FROM fiber_neurons JOIN fibers f ON f.id = fiber_id WHERE neuron_id LIKE 'p:%' AND neuron_id IN (SELECT neuron_id FROM fiber_neurons GROUP BY 1 HAVING count(*) <= 25))",
    ),
)
def jn13(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    members = t.fiber_neurons().filter(F.col("neuron_id").startswith("p:"))
    return links.cross_memory_links(members, t.fibers(), entity_cap=25).withColumn("weight", F.round("weight", 6))


@register(
    "jn14_semantic_links",
    oracle("SELECT a, b, 0.4::DOUBLE AS weight FROM (SELECT x.id AS a, y.id AS b, row_number() OVER (PARTITION BY x.id ORDER BY y.id) AS r FROM neurons x JOIN neurons y ON x.brain_id = y.brain_id AND x.type = y.type AND lower(trim(x.content)) = lower(trim(y.content)) AND y.id > x.id) WHERE r <= 5"),
)
def jn14(spark: SparkSession, sf: str) -> DataFrame:
    return links.semantic_links(Tables(spark, sf).neurons(), per_node=5)


@register("jn15_promote_entities", oracle("SELECT neuron_id AS entity, count(DISTINCT fiber_id) AS mentions, min(fiber_id) AS first_fiber FROM fiber_neurons GROUP BY 1 HAVING count(DISTINCT fiber_id) >= 20"))
def jn15(spark: SparkSession, sf: str) -> DataFrame:
    return links.promote_entities(Tables(spark, sf).fiber_neurons().withColumnRenamed("neuron_id", "entity"), threshold=20)


@register(
    "jn4_new_pairs",
    oracle("SELECT a, b, count(*) AS cnt FROM part_pairs WHERE (a, b) NOT IN (SELECT (least(source_id, target_id), greatest(source_id, target_id)) FROM synapses) GROUP BY 1, 2 HAVING count(*) >= 2"),
)
def jn4(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return joins.new_pairs_only(t.co_activations("part"), t.synapses()).groupBy("a", "b").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt >= 2")


@register("gr6_co_binding", oracle("SELECT query_id, count(*) AS nodes, round(avg(share), 6) AS strength FROM (SELECT query_id, node_id, sum(level) / count(DISTINCT anchor_set) AS share FROM act GROUP BY 1, 2 HAVING count(DISTINCT anchor_set) >= 2) GROUP BY 1", _ACT))
def gr6(spark: SparkSession, sf: str) -> DataFrame:
    return links.co_binding(anchored(Tables(spark, sf))).withColumn("strength", F.round("strength", 6))


_HOPS = """ed AS (SELECT DISTINCT source_id AS a, target_id AS b FROM synapses WHERE type IN ('LEADS_TO', 'CAUSED_BY')),
h_0 AS (SELECT id AS source, id AS node_id, 0 AS hops FROM neurons WHERE id LIKE 'p:%' AND CAST(substr(id, 3) AS INTEGER) % 20 = 0),
h_1 AS (SELECT DISTINCT source, b AS node_id, 1 AS hops FROM h_0 JOIN ed ON a = node_id WHERE (source, b) NOT IN (SELECT (source, node_id) FROM h_0)),
h_2 AS (SELECT DISTINCT source, b AS node_id, 2 AS hops FROM h_1 JOIN ed ON a = node_id WHERE (source, b) NOT IN (SELECT (source, node_id) FROM h_0 UNION ALL SELECT (source, node_id) FROM h_1)),
h_3 AS (SELECT DISTINCT source, b AS node_id, 3 AS hops FROM h_2 JOIN ed ON a = node_id WHERE (source, b) NOT IN (SELECT (source, node_id) FROM h_0 UNION ALL SELECT (source, node_id) FROM h_1 UNION ALL SELECT (source, node_id) FROM h_2)),
hops AS (SELECT * FROM h_0 UNION ALL SELECT * FROM h_1 UNION ALL SELECT * FROM h_2 UNION ALL SELECT * FROM h_3)"""


def asked(t: Tables) -> DataFrame:
    """Every twentieth part, as seeds."""
    return t.read("part").filter("p_partkey % 20 = 0").select(t.key("p", "p_partkey").alias("node_id"))


def causal_edges(t: Tables) -> DataFrame:
    return t.synapses().filter(F.col("type").isin("LEADS_TO", "CAUSED_BY")).select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()


@register("gr7_shortest_hops", oracle("SELECT source, node_id, hops FROM hops", _HOPS))
def gr7(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return links.shortest_hops(asked(t), causal_edges(t), max_hops=3)


@register("gr12_goal_proximity", oracle("SELECT node_id, round(max((CAST(substr(source, 3) AS INTEGER) % 7 + 1) / 10 / (hops + 1)), 6) AS score FROM hops GROUP BY 1", _HOPS))
def gr12(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    goals = asked(t).withColumn("priority", F.substring("node_id", 3, 20).cast("int") % 7 + 1)
    return links.goal_proximity(goals, causal_edges(t)).withColumn("score", F.round("score", 6))


@register(
    "gr11_cascade_staleness",
    oracle(
        "SELECT node_id, min(hops) AS hops FROM hops WHERE hops > 0 GROUP BY 1",
        _HOPS.replace("WHERE type IN ('LEADS_TO', 'CAUSED_BY')", "WHERE type = 'LEADS_TO' AND weight >= 0.3 AND target_id NOT LIKE 'p:%7'"),
    ),
)
def gr11(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    grounded = t.neurons().filter(F.col("id").like("p:%7")).select(F.col("id").alias("node_id"))
    return links.cascade_staleness(asked(t), t.synapses(), grounded)


_PAIRS = """k AS (SELECT fiber_id, tag FROM fiber_tags WHERE origin = 'auto'), s AS (SELECT fiber_id, count(*) AS n FROM k GROUP BY 1),
p AS (SELECT x.fiber_id AS a, y.fiber_id AS b FROM k x JOIN k y ON x.tag = y.tag AND x.fiber_id < y.fiber_id JOIN s sx ON sx.fiber_id = x.fiber_id JOIN s sy ON sy.fiber_id = y.fiber_id GROUP BY x.fiber_id, y.fiber_id, sx.n, sy.n HAVING count(*) / (sx.n + sy.n - count(*)) >= 0.6),
bi AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT a AS id, a AS other FROM bi UNION SELECT r.id, bi.b FROM reach r JOIN bi ON bi.a = r.other),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY 1)"""


def topic_pairs(t: Tables) -> DataFrame:
    return setjoin.overlap_pairs(t.fiber_tags().filter("origin = 'auto'"), key="tag", min_jaccard=0.6)


@register("gr13_components", oracle("SELECT id, component FROM comp", _PAIRS).replace("WITH neurons AS", "WITH RECURSIVE neurons AS", 1))
def gr13(spark: SparkSession, sf: str) -> DataFrame:
    return links.connected_components(topic_pairs(Tables(spark, sf)))


@register("cn4_cluster_summaries", oracle("SELECT component, count(*) AS size, max_by(f.id, (salience, f.id)) AS best, round(max(salience), 6) AS salience FROM comp JOIN fibers f ON f.id = comp.id GROUP BY 1 HAVING count(*) >= 3", _PAIRS).replace("WITH neurons AS", "WITH RECURSIVE neurons AS", 1))
def cn4(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return links.cluster_summaries(topic_pairs(t), t.fibers()).withColumn("salience", F.round("salience", 6))


@register(
    "rk4_trimodal_fusion",
    oracle(
        """SELECT query_id, fiber_id, round(sum(w * s) / max(total), 6) AS score FROM (SELECT *, 1.0 AS total, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 1.0 END AS s FROM (SELECT *, min(v) OVER (PARTITION BY query_id, c) AS lo, max(v) OVER (PARTITION BY query_id, c) AS hi FROM (
    SELECT brain_id AS query_id, id AS fiber_id, salience AS v, 0.5 AS w, 'g' AS c FROM fibers WHERE salience >= 0.9 UNION ALL SELECT brain_id, id, frequency, 0.3, 's' FROM fibers WHERE frequency >= 9 UNION ALL SELECT brain_id, id, created_day, 0.2, 'l' FROM fibers WHERE created_day >= 11000))) GROUP BY 1, 2"""
    ),
)
def rk4(spark: SparkSession, sf: str) -> DataFrame:
    f = Tables(spark, sf).fibers().withColumnRenamed("brain_id", "query_id").withColumnRenamed("id", "fiber_id")
    part = lambda c, least: f.filter(F.col(c) >= least).select("query_id", "fiber_id", F.col(c).cast("double").alias("score"))
    return links.trimodal_fusion([("g", part("salience", 0.9), 0.5), ("s", part("frequency", 9), 0.3), ("l", part("created_day", 11000), 0.2)]).withColumn("score", F.round("score", 6))


@register(
    "rk7_stabilize",
    oracle(
        "SELECT query_id, node_id, round(level, 6) AS level FROM r3",
        _SPREAD
        + "".join(
            f""", r{n} AS (SELECT query_id, node_id, least(1.0, greatest(0.0, l * least(3.0, 1 + 0.3 * (0.5 / avg(l) OVER (PARTITION BY query_id) - 1)))) AS level FROM (SELECT query_id, node_id, level * 0.85 AS l FROM {'reached' if n == 1 else f'r{n - 1}'} WHERE level >= 0.05))"""
            for n in (1, 2, 3)
        ),
    ),
)
def rk7(spark: SparkSession, sf: str) -> DataFrame:
    return links.stabilize(reached(Tables(spark, sf))).withColumn("level", F.round("level", 6))


@register(
    "rk10_validity_penalty",
    oracle("SELECT query_id, r.node_id, round(level * CASE WHEN valid_from > 10500 OR valid_until < 10500 THEN 0.1 ELSE 1 END, 6) AS level FROM reached r LEFT JOIN (SELECT id AS node_id, created_day AS valid_from, last_day AS valid_until FROM neuron_states) v ON v.node_id = r.node_id", _SPREAD),
)
def rk10(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    v = t.neuron_states().select("id", F.col("created_day").alias("valid_from"), F.col("last_day").alias("valid_until"))
    return links.validity_penalty(reached(t), v, as_of=10500).withColumn("level", F.round("level", 6))


@register(
    "rk14_sufficiency",
    oracle(
        "SELECT query_id, round(-sum(p * log2(p)), 6) AS entropy, round(sum(CASE WHEN r <= 3 THEN p ELSE 0 END), 6) AS focus, round(max(level), 6) AS top, count(*) AS n FROM (SELECT *, level / sum(level) OVER (PARTITION BY query_id) AS p, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, node_id) AS r FROM reached WHERE level > 0) GROUP BY 1",
        _SPREAD,
    ),
)
def rk14(spark: SparkSession, sf: str) -> DataFrame:
    return links.sufficiency(reached(Tables(spark, sf))).select("query_id", *[F.round(c, 6).alias(c) for c in ("entropy", "focus", "top")], "n")


@register(
    "qh6_alerts",
    oracle(
        "SELECT session_id, action, moment AS \"at\" FROM run WHERE moment IS NOT NULL",
        """cand AS (SELECT session_id, action, list(at_us // 1000000 ORDER BY at_us // 1000000) AS ts FROM acts WHERE action = 'error' GROUP BY 1, 2),
    run AS (SELECT session_id, action, ts[1] AS moment, ts FROM cand UNION ALL SELECT session_id, action, list_min(list_filter(ts, lambda x: x >= moment + 86400)), ts FROM run WHERE moment IS NOT NULL)""",
    ).replace("WITH neurons AS", "WITH RECURSIVE neurons AS", 1),
)
def qh6(spark: SparkSession, sf: str) -> DataFrame:
    e = Tables(spark, sf).events().filter("action = 'error'").select("session_id", "action", F.floor(F.col("at_us") / 1_000_000).alias("at"))
    return links.alerts(e, cooldown=86400, by=("session_id", "action"))


@register(
    "sc26_depth_prior",
    oracle("SELECT entity, depth, CAST(a AS BIGINT) AS alpha, CAST(b AS BIGINT) AS beta, round(a / (a + b), 6) AS rate FROM (SELECT session_id AS entity, id % 3 AS depth, 1 + count(*) FILTER (success) AS a, 1 + count(*) FILTER (NOT success) AS b FROM acts GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY a / (a + b) DESC, depth) = 1"),
)
def sc26(spark: SparkSession, sf: str) -> DataFrame:
    e = Tables(spark, sf).events().select(F.col("session_id").alias("entity"), (F.col("id") % 3).alias("depth"), "success")
    return links.depth_prior(e).withColumn("rate", F.round("rate", 6))


@register(
    "tk8_multi_dim_query",
    oracle("SELECT query_id, node_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, node_id) AS rank FROM fused) WHERE rank > 5 AND rank <= 15", _LISTS),
)
def tk8(spark: SparkSession, sf: str) -> DataFrame:
    from engram.operators.ranking import multi_dim_query

    return multi_dim_query(ranked_lists(Tables(spark, sf)), limit=10, offset=5).withColumn("score", F.round("score", 6))


@register("ag14_sketch_stats")
def ag14(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return t.neuron_states().groupBy("brain_id").agg(F.approx_count_distinct("id").alias("nodes"), F.percentile_approx("activation_level", [0.5, 0.9, 0.99]).alias("levels"))


@register("cn5_rehearsal_days", oracle("SELECT days, count(*) AS cnt FROM (SELECT coalesce(days, 0) AS days FROM fibers LEFT JOIN (SELECT 'f:' || l_orderkey AS fiber_id, count(DISTINCT l_shipdate) AS days FROM lineitem GROUP BY 1) ON id = fiber_id) GROUP BY days"))
def rehearsal_days(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.count_by(maturations(Tables(spark, sf)), "days")


# ---- text and sources


@register("src6_html_to_text")
def src6(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).read("pages").select("page_id", "url", text.html_to_text("html").alias("text"))


@register("dd17_chunk_markdown")
def dd17(spark: SparkSession, sf: str) -> DataFrame:
    pages = Tables(spark, sf).read("pages").select(F.col("page_id").alias("doc_id"), text.html_to_text("html").alias("text"))
    return text.chunk_markdown(pages, min_words=5, max_words=60)


@register("wn7_sibling_order")
def wn7(spark: SparkSession, sf: str) -> DataFrame:
    return text.sibling_order(dd17(spark, sf))


_KINDS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS pattern, {s} AS severity, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS matches FROM documents" for k, (s, p) in text.SENSITIVE.items())


@register("dd6_sensitive_scan", f"SELECT * FROM ({_KINDS}) WHERE matches > 0")
def dd6(spark: SparkSession, sf: str) -> DataFrame:
    return text.sensitive_counts(Tables(spark, sf).read("documents"))


_REDACTED = "text"
for _k, (_s, _p) in text.SENSITIVE.items():
    if _s >= 2:
        _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '[{_k}]', 'g')"


@register("dd7_redact", f"SELECT doc_id, sha256({_REDACTED}) AS hash FROM documents")
def dd7(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).read("documents").select("doc_id", F.sha2(text.redact(F.col("text")).cast("binary"), 256).alias("hash"))


@register(
    "dd8_noise_reason",
    r"""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 50000 THEN 'too long' WHEN length(regexp_replace(text, '[^\p{L}\p{Nd}\s]', '', 'g')) < 0.5 * length(text) THEN 'symbols'
    WHEN len(w) >= 20 AND len(list_distinct(w)) < 0.2 * len(w) THEN 'repetition' END AS reason FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)""",
)
def dd8(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).read("documents").select("doc_id", text.noise_reason(F.col("text")).alias("reason"))


@register("sc4_token_counts", r"SELECT t AS token, count(*) AS cnt FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')) AS t FROM conversations) GROUP BY 1")
def sc4(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.count_by(Tables(spark, sf).read("conversations").select(F.explode(text.tokens(F.col("text"))).alias("token")), "token")


@register(
    "sc5_fuzzy_match",
    """WITH t AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, 2) || substr(p_name, 4) WHEN 1 THEN reverse(substr(p_name, 1, 2)) || substr(p_name, 3) ELSE p_name || 's' END AS term FROM part WHERE p_partkey % 20 = 0)
    SELECT DISTINCT term, w AS word, CAST(levenshtein(term, w) AS INTEGER) AS distance FROM t, (SELECT DISTINCT p_name AS w FROM part) WHERE levenshtein(term, w) <= 2""",
)
def sc5(spark: SparkSession, sf: str) -> DataFrame:
    """Names of every twentieth part, with a letter lost, two exchanged or one more."""
    p = Tables(spark, sf).read("part")
    n, cut = F.col("p_partkey") % 3, lambda a, z=None: F.substr("p_name", F.lit(a), *([F.lit(z)] if z else []))
    term = F.when(n == 0, F.concat(cut(1, 2), cut(4))).when(n == 1, F.concat(F.reverse(cut(1, 2)), cut(3))).otherwise(F.concat("p_name", F.lit("s")))
    return anchors.fuzzy_words(p.filter("p_partkey % 20 = 0").select(term.alias("term")), p.select(F.col("p_name").alias("word")))


@register(
    "src7_parse_events",
    "SELECT event_type AS tool_name, count(*) AS cnt, count(*) FILTER (event_id % 10 = 0) AS bad FROM events GROUP BY 1",
)
def src7(spark: SparkSession, sf: str) -> DataFrame:
    e = Tables(spark, sf).read("events")
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("tool_name"), F.col("props").alias("args_summary"), F.col("value").alias("duration_ms")))
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), line)).otherwise(line)
    parsed = files.parse_events(e.select("event_type", broken.alias("value")))
    kinds = e.select(F.col("event_type").alias("tool_name")).groupBy("tool_name").agg(F.count(F.lit(1)).alias("cnt"))
    good = parsed.filter("not bad").groupBy("tool_name").agg(F.count(F.lit(1)).alias("good"))
    return kinds.join(good, "tool_name", "left").select("tool_name", "cnt", (F.col("cnt") - F.coalesce("good", F.lit(0))).alias("bad"))


@register("src9_incremental_import", "SELECT doc_id AS record_id, source AS source_system FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def src9(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    d = t.read("documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("source_system"), F.col("n_chars").alias("updated_at"))
    done = t.read("labels").select(F.col("doc_id").alias("record_id")).join(d.select("record_id", "source_system"), "record_id")
    return files.incremental_import(d, done, last_sync=F.lit(500)).select("record_id", "source_system")


@register("src10_skip_known_files", "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def src10(spark: SparkSession, sf: str) -> DataFrame:
    d = Tables(spark, sf).read("documents").select("doc_id", F.col("text").alias("content"))
    known = d.filter("doc_id % 3 = 0").select(F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    return files.skip_known_files(d, known).select("doc_id", "sha256")


@register(
    "src8_map_records",
    "SELECT relation, count(*) AS cnt FROM (SELECT DISTINCT 'supplied_by' AS relation, l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1",
)
def src8(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    p = t.read("part").select(F.lit("erp").alias("source_system"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("record_id"), F.lit("item").alias("kind"), F.col("p_name").alias("content"))
    s = t.read("supplier").select(F.lit("erp"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.lit("firm"), "s_name")
    r = t.read("lineitem").select(F.lit("erp").alias("source_system"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("from_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to_id"), F.lit("supplied_by").alias("relation")).distinct()
    return aggregates.count_by(files.map_records(p.union(s), r, {"item": "CONCEPT", "firm": "ENTITY"})[1], "relation")


@register(
    "flt13_simhash_exclude",
    "WITH " + _HASHES.replace("SELECT doc_id AS id, ", "SELECT id, ").replace("FROM documents", "FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark WHERE item_id % 20 = 0)")
    + " SELECT -1 - q.id AS query_id, d.id AS node_id FROM hashed q JOIN hashed d ON q.id < 0 AND d.id >= 0 WHERE bit_count(xor(q.hash, d.hash)) > 20",
)
def flt13(spark: SparkSession, sf: str) -> DataFrame:
    from engram.operators.dedup import hamming, simhash

    t = Tables(spark, sf)
    d = t.read("documents").select(F.col("doc_id").alias("node_id"), simhash("text").alias("hash"))
    q = t.read("benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), simhash("text").alias("q"))
    out = None
    for i in range(max(1, -(-q.count() // 1000))):  # a stated query set against all rows, in blocks of a thousand
        some = q.orderBy("query_id").offset(1000 * i).limit(1000)
        part = d.join(F.broadcast(some), hamming(F.col("hash"), F.col("q")) > 20).select("query_id", "node_id")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "wn5_retriever_weights",
    oracle(
        """SELECT retriever, round(least(2.0, greatest(0.1, 0.7 * (0.5 + ema))), 6) AS weight FROM (SELECT retriever, sum(CASE WHEN k = last THEN pow(1 - 2.0 / 11, k) ELSE 2.0 / 11 * pow(1 - 2.0 / 11, k) END * v) AS ema
    FROM (SELECT *, max(k) OVER (PARTITION BY retriever) AS last FROM (SELECT action AS retriever, CASE WHEN duration_ms > 50 THEN 1.0 ELSE 0.0 END AS v, row_number() OVER (PARTITION BY action ORDER BY at_us DESC, id DESC) - 1 AS k FROM acts) WHERE k < 10) GROUP BY 1)"""
    ),
)
def wn5(spark: SparkSession, sf: str) -> DataFrame:
    from engram.operators.windows import ema

    e = ema(Tables(spark, sf).events(), by="action", order=[F.col("at_us"), F.col("id")], value=(F.col("duration_ms") > 50).cast("int"), window=10)
    return e.select(F.col("action").alias("retriever"), F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.1), 0.7 * (0.5 + F.col("ema")))), 6).alias("weight"))


@register(
    "tk5_cone",
    """SELECT query_id, node_id, round(sim, 6) AS sim FROM (SELECT q.vec_id AS query_id, v.vec_id AS node_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS r FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE r <= 100 AND sim >= 0.2""",
)
def tk5(spark: SparkSession, sf: str) -> DataFrame:
    v = Tables(spark, sf).read("embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    near = topk.knn(v, v.filter("node_id % 20 = 0").withColumnRenamed("node_id", "query_id"), 100)
    return near.filter("sim >= 0.2").select("query_id", "node_id", F.round("sim", 6).alias("sim"))


@register("set1_weight_changes", oracle("SELECT brain_id, count(*) AS cnt FROM synapses WHERE type = 'INVOLVES' AND reinforced_count > 1 GROUP BY brain_id"))
def set1_weights(spark: SparkSession, sf: str) -> DataFrame:
    s = Tables(spark, sf).synapses().filter("type = 'INVOLVES'")
    new = s.withColumn("weight", F.col("weight") + F.when(F.col("reinforced_count") > 1, 0.01).otherwise(0.0))
    return aggregates.count_by(sets.weight_changes(s, new).join(s.select("id", "brain_id"), "id"), "brain_id")


@register(
    "gr1_walkable_degree",
    oracle("SELECT source_id AS source, count(DISTINCT target_id) AS cnt FROM synapses WHERE weight >= 0.1 GROUP BY 1 HAVING count(DISTINCT target_id) >= 60"),
)
def walkable_degree(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.count_by(walkable(Tables(spark, sf).synapses()), "source").filter("cnt >= 60")


@register(
    "gr18_scoped_subgraph",
    oracle("SELECT count(*) AS edges FROM synapses WHERE source_id IN (SELECT node_id FROM reached) AND target_id IN (SELECT node_id FROM reached)", _SPREAD),
)
def gr18(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    nodes = reached(t).select("node_id").distinct()
    inside = t.synapses().join(nodes.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(nodes.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    return inside.agg(F.count(F.lit(1)).alias("edges"))


@register(
    "rk22_suggest_next",
    oracle(
        "SELECT a, b, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cnt DESC, b) AS rank FROM (SELECT a, b, count(*) AS cnt FROM (SELECT action AS a, lead(action) OVER w AS b, lead(at_us) OVER w - at_us AS gap FROM acts WINDOW w AS (PARTITION BY session_id ORDER BY at_us, id)) WHERE b IS NOT NULL AND gap <= 21600000000 GROUP BY a, b)) WHERE rank <= 2"
    ),
)
def rk22(spark: SparkSession, sf: str) -> DataFrame:
    from engram.operators.windows import per_group_topk, sequential_pairs

    pairs = sequential_pairs(Tables(spark, sf).events(), window_us=21_600_000_000)
    return per_group_topk(pairs, keys=["a"], order=[F.col("cnt").desc(), F.col("b")], k=2).select("a", "b", "cnt", "rank")

