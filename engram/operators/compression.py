"""Texts of old memories made shorter by tiers, with a backup of what was cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.anchors import words_of
from engram.operators.graph import settled

#: Days from which a text is cut to its best sentences, to those that name something, to a template, and to its graph.
DAYS = (7.0, 30.0, 90.0, 180.0)
#: Words whose full stop ends no sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "etc", "e.g", "i.e", "fig", "approx", "est", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SENTENCES, RESIST, NEVER_BELOW = 5, 0.5, 0.8
_MARK = "\x1e"


def split_sentences(text: Column) -> Column:
    """Sentences end at a full stop, ! or ? before white space and a capital or a quote, but not after an abbreviation."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    cut = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"([.!?])\s+([A-Z\"])", f"$1{_MARK}$2")
    cut = F.regexp_replace(cut, rf"(?i)(^|[\s{_MARK}])({short})([.!?]+){_MARK}", "$1$2$3 ")
    return F.filter(F.transform(F.split(cut, _MARK), lambda s: F.trim(s)), lambda s: s != "")


def target_tier(age_days: Column, heat: Column, frozen: Column) -> Column:
    """0 (whole) to 4 (graph only): by age; a warm memory resists by a tier, a hot one keeps its best sentences, a frozen one stays whole."""
    base = F.when(age_days < DAYS[0], 0).when(age_days < DAYS[1], 1).when(age_days < DAYS[2], 2).when(age_days < DAYS[3], 3).otherwise(4)
    warm = F.when((heat > RESIST) & (base > 0), base - 1).otherwise(base)
    return F.when(F.coalesce(frozen, F.lit(False)), 0).otherwise(F.when((heat > NEVER_BELOW) & (warm > 1), 1).otherwise(warm)).cast("int")


def compress(memories: DataFrame, names: DataFrame, relations: DataFrame | None = None, *, as_of: int, most: int = SENTENCES) -> DataFrame:
    """id, old_tier, tier, content, tokens_before, tokens_after, kept (sentences or names), backup: memories whose target tier is above their own.

    memories: id, content, created_day, tier, heat, frozen; names: id, name (what the memory's nodes say); relations: id, pos, relation. A
    sentence's density is the number of names that it holds as whole words, for each of its words, 1 at most. Tier 1 keeps the densest sentences,
    the first one among them; tier 2 those that hold a name; tier 3 says "a relation b" of names that follow each other in order;
    tier 4 keeps nothing. The backup is the text before tiers 1 and 2. A memory at its tier is not in the result, so a second run changes nothing.
    """
    tier = target_tier(F.lit(as_of) - F.col("created_day"), F.coalesce("heat", F.lit(0.0)), F.col("frozen"))
    m = memories.select("id", "content", F.coalesce("tier", F.lit(0)).alias("old_tier"), tier.alias("new_tier")).filter("new_tier > old_tier")
    m = settled(m)
    s = m.filter("new_tier <= 2").select("id", "new_tier", F.posexplode(split_sentences(F.col("content"))).alias("pos", "sentence"))
    s = settled(s.withColumn("words", F.size(F.filter(F.split("sentence", r"\s+"), lambda w: w != ""))))
    n = names.filter("name <> ''").distinct().withColumn("word", F.get(words_of(F.col("name")), F.lit(0))).filter("word is not null")
    said = s.select("id", "pos", "sentence", F.explode(F.array_distinct(words_of(F.col("sentence")))).alias("word"))
    held = said.join(n, ["id", "word"]).filter(F.contains(F.lower("sentence"), F.lower("name"))).groupBy("id", "pos").agg(F.count(F.lit(1)).alias("hits"))
    s = s.join(held, ["id", "pos"], "left").withColumn("density", F.round(F.least(F.lit(1.0), F.coalesce("hits", F.lit(0)) / F.greatest("words", F.lit(1))), 9))
    order = Window.partitionBy("id").orderBy(F.col("density").desc(), "pos")
    first_place = F.max(F.when(F.col("pos") == 0, F.col("place"))).over(Window.partitionBy("id"))
    s = s.withColumn("place", F.row_number().over(order)).withColumn("first", first_place)
    best = (F.col("pos") == 0) | (F.col("place") <= F.when(F.col("first") > most, most - 1).otherwise(most))
    kept = s.filter(F.when(F.col("new_tier") == 1, best).otherwise(F.col("density") > 0))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")
    kept = kept.groupBy("id").agg(text.alias("text"), F.sum((F.col("density") > 0).cast("long")).alias("kept"))
    third = m.filter("new_tier = 3").select("id").join(names.filter("name <> ''").distinct(), "id")
    w = Window.partitionBy("id").orderBy("name")
    third = third.withColumns({"pos": F.row_number().over(w) - 1, "next": F.lead("name").over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("id"))})
    third = third.join(relations.select("id", "pos", "relation"), ["id", "pos"], "left") if relations is not None else third.withColumn("relation", F.lit(None).cast("string"))
    opening = F.max(F.when(F.col("pos") == 0, F.col("relation"))).over(Window.partitionBy("id"))
    third = third.withColumn("relation", F.coalesce("relation", opening, F.lit("related_to"))).filter("next is not null or n = 1")
    said3 = F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws(" ", "name", "relation", "next"))
    third = third.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", said3.alias("s")))), lambda x: x["s"]), "; ").alias("text"), F.max("n").alias("kept"))
    out = m.join(kept.unionByName(third), "id", "left")
    count = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    content = F.coalesce("text", F.lit(""))
    return out.select("id", "old_tier", F.col("new_tier").alias("tier"), content.alias("content"), count("content").alias("tokens_before"), count(content).alias("tokens_after"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.when(F.col("new_tier") <= 2, F.col("content")).alias("backup"))


def applied(memories: DataFrame, compressed: DataFrame) -> DataFrame:
    """The memories with their new texts and tiers."""
    new = compressed.select("id", F.col("content").alias("new_content"), F.col("tier").alias("new_tier"))
    changed = F.col("new_tier").isNotNull()
    out = memories.join(new, "id", "left")
    return out.withColumns({"content": F.when(changed, F.col("new_content")).otherwise(F.col("content")), "tier": F.when(changed, F.col("new_tier")).otherwise(F.col("tier"))}).drop("new_content", "new_tier")


def restored(memories: DataFrame, backups: DataFrame) -> DataFrame:
    """Memories (id, content, tier) as they were before tiers 1 and 2. backups: id, old_tier, backup."""
    old = backups.filter("backup is not null").select("id", "backup", "old_tier")
    out = memories.join(old, "id", "left")
    known = F.col("backup").isNotNull()
    return out.withColumns({"content": F.when(known, F.col("backup")).otherwise(F.col("content")), "tier": F.when(known, F.col("old_tier")).otherwise(F.col("tier"))}).drop("backup", "old_tier")
