"""Queries of captured memories, surprise, dreams, reflections and package checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.fixtures import Tables, oracle
from engram.functions import capture, extract
from engram.operators import graph, insight
from engram.operators.dedup import hamming, simhash
from engram.plans.encoding import _FOUND
from engram.plans.memory import _FACTOR, _HASHES
from engram.plans.registry import register
from engram.plans.signals import _SAID_TOO, q, said_too

_CAUGHT = " UNION ALL ".join(
    f"SELECT id, {i} AS turn, {j} AS nth, '{kind}' AS type, {q(prefix)} AS prefix, {c}::DOUBLE AS c, {p} AS priority, unnest(list_filter(list_transform(regexp_extract_all(low, {q(pattern)}, 1), lambda x: trim(x)), lambda x: length(x) >= {least})) AS x FROM low"
    for i, (kind, prefix, c, p, least, patterns) in enumerate(capture.CAPTURE) for j, pattern in enumerate(patterns)
)
_CUT = "CASE " + " ".join(f"WHEN regexp_extract(x, '^(.{{50,}}?)[{m}]', 1) <> '' THEN regexp_extract(x, '^(.{{50,}}?)[{m}]', 1)" for m in "!?;") + " ELSE x END"


@register("dd10_auto_capture", f"WITH {_SAID_TOO}, low AS (SELECT id, lower(coalesce(text, '')) AS low FROM texts), c AS ({_CAUGHT}), d AS (SELECT id, type, prefix || CASE WHEN length(x) > 100 THEN {_CUT} ELSE x END AS content, round(CASE WHEN length(x) > 200 THEN c * 0.7 WHEN length(x) < 10 THEN c * 0.3 ELSE c END, 4) AS confidence, priority, turn, nth FROM c) SELECT id, type, content, max(confidence) AS confidence, min(priority) AS priority FROM d GROUP BY id, type, content")
def dd10(spark: SparkSession, sf: str) -> DataFrame:
    m = said_too(Tables(spark, sf)).select("id", F.explode(capture.memories(F.col("text"))).alias("m")).select("id", "m.*")
    return m.groupBy("id", "type", "content").agg(F.max("confidence").alias("confidence"), F.min("priority").alias("priority"))


_TURNS = """turns AS (SELECT 't:' || conv_id || ':' || turn AS id, conv_id, turn, lower(text) AS t FROM conversations WHERE text IS NOT NULL),"""
_CORE = lambda x: f"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace({x}, {q(insight.NEGATION)}, '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains([{', '.join(map(q, insight.STOP))}], w)))"
_HAS = lambda x, w: f"regexp_matches({x}, '(?:^|[^a-z0-9_]){w}(?:[^a-z0-9_]|$)')"
_OPPOSITE = " OR ".join(f"({_HAS('a.t', x)} AND {_HAS('b.t', y)}) OR ({_HAS('a.t', y)} AND {_HAS('b.t', x)})" for x, y in capture.OPPOSITES)


@register(
    "dd15_surprise",
    "WITH " + _TURNS + _HASHES.replace("SELECT doc_id AS id, ", "SELECT id, ").replace("FROM documents", "FROM (SELECT id, t AS text FROM turns)")
    + f""", p AS (SELECT a.id, (regexp_matches(a.t, {q(insight.NEGATION)}) <> regexp_matches(b.t, {q(insight.NEGATION)}) AND len(list_intersect({_CORE('a.t')}, {_CORE('b.t')})) >= 2) OR {_OPPOSITE} AS rev, bit_count(xor(x.hash, y.hash)) AS bits
      FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 3 AND a.turn - 1 JOIN hashed x ON x.id = a.id JOIN hashed y ON y.id = b.id),
    g AS (SELECT id, bool_or(rev) AS rev, min(bits) AS bits FROM p GROUP BY id)
    SELECT t.id, round(CASE WHEN bits IS NULL THEN 1.5 WHEN rev THEN 2.5 WHEN bits < 5 THEN 0.0 WHEN bits < 15 THEN (bits - 5) / 10 WHEN bits < 30 THEN 1 + (bits - 15) / 15 ELSE 2.0 END, 6) AS surprise FROM turns t LEFT JOIN g USING (id)""",
)
def dd15(spark: SparkSession, sf: str) -> DataFrame:
    """Turns against the three turns before them in their conversation."""
    c = Tables(spark, sf).read("conversations").filter("text is not null")
    c = c.select(F.concat(F.lit("t:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn", "text", simhash("text").alias("hash"))
    later = c.select("id", "conv_id", "text", "hash", F.explode(F.array(*[F.col("turn") - i for i in (1, 2, 3)])).alias("at"))
    pairs = later.join(c.select("conv_id", F.col("turn").alias("at"), F.col("text").alias("other"), F.col("hash").alias("theirs")), ["conv_id", "at"])
    near = pairs.groupBy("id").agg(F.max(capture.reversal(F.col("text"), F.col("other"))).alias("rev"), F.min(hamming(F.col("hash"), F.col("theirs"))).alias("bits"))
    return c.select("id").join(near, "id", "left").select("id", F.round(capture.surprise(F.coalesce("rev", F.lit(False)), F.col("bits")), 6).alias("surprise"))


@register(
    "qh9_reflection",
    f"WITH texts AS (SELECT conv_id || ':' || turn AS id, conv_id, text FROM conversations), f AS ({_FOUND}) SELECT kind, name, count(DISTINCT split_part(id, ':', 1)) AS conversations, count(*) AS turns FROM (SELECT id, kind, unnest(names) AS name FROM f) GROUP BY 1, 2 HAVING count(DISTINCT split_part(id, ':', 1)) >= 3",
)
def qh9(spark: SparkSession, sf: str) -> DataFrame:
    """Names that come again in three conversations or more."""
    c = Tables(spark, sf).read("conversations").select("conv_id", F.explode(extract.entities(F.col("text"))).alias("e"))
    return c.groupBy("e.kind", "e.name").agg(F.countDistinct("conv_id").alias("conversations"), F.count(F.lit(1)).alias("turns")).filter("conversations >= 3")


@register(
    "dd21_package_scan",
    oracle(
        """SELECT brain_id, finding, count(*) AS cnt, CASE finding WHEN 'self_loop' THEN 'medium' ELSE 'low' END AS severity FROM (
      SELECT brain_id, 'self_loop' AS finding FROM synapses WHERE source_id = target_id
      UNION ALL SELECT s.brain_id, 'dangling_source' FROM synapses s LEFT JOIN pk ON pk.id = s.source_id WHERE pk.id IS NULL
      UNION ALL SELECT s.brain_id, 'dangling_target' FROM synapses s LEFT JOIN pk ON pk.id = s.target_id WHERE pk.id IS NULL
) GROUP BY 1, 2""",
        "pk AS (SELECT id FROM neurons WHERE type <> 'SPATIAL')",
    ),
)
def dd21(spark: SparkSession, sf: str) -> DataFrame:
    """A package that leaves the places out: its edges to them dangle."""
    t = Tables(spark, sf)
    return insight.package_findings(t.neurons().filter("type <> 'SPATIAL'"), t.synapses())


_DREAM = f"""edge AS (SELECT source_id AS s, target_id AS t, max(weight * {_FACTOR}) AS f FROM synapses WHERE weight >= 0.1 GROUP BY 1, 2),
h0 AS (SELECT id AS q, id AS node, 1.0::DOUBLE AS level FROM (SELECT id, row_number() OVER (ORDER BY md5('7' || id), id) AS r FROM neurons) WHERE r <= 20),
h1 AS (SELECT q, t AS node, max(level * 0.5 * f) AS level FROM h0 JOIN edge ON s = node GROUP BY 1, 2 HAVING max(level * 0.5 * f) >= 0.1),
h2 AS (SELECT q, t AS node, max(level * 0.5 * f) AS level FROM h1 JOIN edge ON s = node GROUP BY 1, 2 HAVING max(level * 0.5 * f) >= 0.1),
r AS (SELECT q, node, row_number() OVER (PARTITION BY q ORDER BY round(max(level), 9) DESC, node) AS place FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2),
lk AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM synapses)"""


@register("cn10_dream", oracle("SELECT DISTINCT x.node AS source_id, y.node AS target_id, 'RELATED_TO' AS type, 0.1::DOUBLE AS weight FROM r x JOIN r y ON x.q = y.q AND x.node < y.node AND x.place <= 12 AND y.place <= 12 WHERE (x.node, y.node) NOT IN (SELECT (a, b) FROM lk)", _DREAM))
def cn10(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return insight.dream(t.neurons(), t.synapses(), graph.walkable(t.synapses()), seed=7, count=20, most=12, min_level=0.1)
