"""Queries of compressed texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.fixtures import Tables
from engram.operators import compression
from engram.plans.registry import register
from engram.plans.signals import q

# documents as memories of an age by id; what they name are words of seven letters or more with a capital
_NAME = "[A-Z][a-z]{6,}"
_SHORT = "|".join(a.replace(".", r"\.") for a in compression.ABBREVIATIONS)
_CUT = f"regexp_replace(regexp_replace(trim(coalesce(text, ''), ' '), '([.!?])\\s+([A-Z\"])', '\\1' || chr(30) || '\\2', 'g'), '(?i)(^|[\\s' || chr(30) || '])({_SHORT})([.!?]+)' || chr(30), '\\1\\2\\3 ', 'g')"
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"


@register(
    "dd19_compress_text",
    f"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN heat > 0.8 AND warm > 1 THEN 1 ELSE warm END AS tier FROM (SELECT *, CASE WHEN heat > 0.5 AND base > 0 THEN base - 1 ELSE base END AS warm
      FROM (SELECT doc_id, text, (doc_id % 10) / 10 AS heat, CASE WHEN doc_id % 200 < 7 THEN 0 WHEN doc_id % 200 < 30 THEN 1 WHEN doc_id % 200 < 90 THEN 2 WHEN doc_id % 200 < 180 THEN 3 ELSE 4 END AS base FROM documents))),
    names AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, {q(_NAME)})) AS name FROM d),
    s AS (SELECT id, tier, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT id, tier, list_filter(list_transform(string_split({_CUT}, chr(30)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM d WHERE tier BETWEEN 1 AND 2)),
    h AS (SELECT s.id, pos, count(*) AS hits FROM (SELECT id, pos, sentence, unnest({_WORDS.format('sentence')}) AS w FROM s) s JOIN names n ON n.id = s.id AND lower(n.name) = w GROUP BY 1, 2),
    g AS (SELECT s.*, round(least(1.0, coalesce(hits, 0) / greatest(1, len(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda w: w <> '')))), 9) AS density FROM s LEFT JOIN h ON h.id = s.id AND h.pos = s.pos),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY density DESC, pos) AS place FROM g),
    f AS (SELECT *, max(CASE WHEN pos = 0 THEN place END) OVER (PARTITION BY id) AS first FROM r),
    k AS (SELECT id, string_agg(sentence, ' ' ORDER BY pos) AS text, count(*) FILTER (density > 0) AS kept FROM f WHERE CASE tier WHEN 1 THEN pos = 0 OR place <= CASE WHEN first > 5 THEN 4 ELSE 5 END ELSE density > 0 END GROUP BY 1),
    t AS (SELECT id, string_agg(CASE WHEN n = 1 THEN name ELSE name || ' related_to ' || nxt END, '; ' ORDER BY name) AS text, max(n) AS kept FROM (SELECT id, name, lead(name) OVER (PARTITION BY id ORDER BY name) AS nxt, count(*) OVER (PARTITION BY id) AS n FROM names JOIN d USING (id) WHERE tier = 3) WHERE nxt IS NOT NULL OR n = 1 GROUP BY 1),
    o AS (SELECT d.id, tier, d.text AS old, coalesce(k.text, t.text, '') AS content, coalesce(k.kept, t.kept, 0) AS kept FROM d LEFT JOIN k ON k.id = d.id LEFT JOIN t ON t.id = d.id WHERE tier > 0)
    SELECT id, tier, md5(content) AS content, CAST(len(list_filter(regexp_split_to_array(old, '\\s+'), lambda w: w <> '')) AS INTEGER) AS tokens_before, CAST(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS INTEGER) AS tokens_after, kept, CASE WHEN tier <= 2 THEN md5(old) END AS backup FROM o""",
)
def dd19(spark: SparkSession, sf: str) -> DataFrame:
    d = Tables(spark, sf).read("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), (1000 - F.col("doc_id") % 200).alias("created_day"), F.lit(0).alias("tier"), ((F.col("doc_id") % 10) / 10).alias("heat"), (F.col("doc_id") % 11 == 0).alias("frozen"))
    names = d.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_NAME), F.lit(0)))).alias("name"))
    out = compression.compress(d, names, as_of=1000)
    return out.select("id", "tier", F.md5("content").alias("content"), "tokens_before", "tokens_after", "kept", F.md5("backup").alias("backup"))
