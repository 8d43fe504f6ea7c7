"""Shorter texts that keep the direction of their vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of the text's own direction and of the best related one, and the score of a sentence without a vector.
OWN, RELATED, UNKNOWN = 0.6, 0.4, 0.5
GHOST_WORDS = 5


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    x, y = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((x < 1e-10) | (y < 1e-10), 0.0).otherwise(dot(a, b) / (x * y))


def sentences(text: Column) -> Column:
    """Trimmed sentences, cut behind `.`, `!` and `?` that white space follows."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def semantic_compress(docs: DataFrame, parts: DataFrame, related: DataFrame, *, max_axes: int = 3) -> DataFrame:
    """doc_id, level, content, kept, total: texts of which the sentences nearest to their vectors remain, in order.

    docs: doc_id, text, level (full, summary, essence, ghost), vector; parts: doc_id, pos, sentence, vector; related: doc_id, place, vector, of
    which the first max_axes count. A sentence's score is 0.6 of its cosine with the text's vector and 0.4 of the best with a related one (0
    without any); without a vector it is 0.5. Summaries keep two thirds of the sentences, essences one (rounded down, at least one), by score and
    position; a sentence that is said again is kept wherever it stands. Full texts and those of one sentence stay as they are; ghosts are the first five
    words. A text without a vector keeps the same share of its words from the start. A null text is empty; a null level is summary; doc_id is unique in docs.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.lower("level"), F.lit("summary")).alias("level"), "vector")
    share = F.when(F.col("level") == "summary", 2).otherwise(1)
    axes = related.filter(F.col("place") < max_axes).filter("vector is not null").groupBy("doc_id").agg(F.collect_list("vector").alias("axes"))  # at most max_axes a text
    asked = docs.filter("vector is not null and level not in ('full', 'ghost')").select("doc_id", "level", F.col("vector").alias("own")).join(axes, "doc_id", "left")
    best = F.coalesce(F.array_max(F.transform("axes", lambda a: cosine(F.col("vector"), a))), F.lit(0.0))
    score = F.when(F.col("vector").isNull(), UNKNOWN).otherwise(OWN * cosine(F.col("vector"), F.col("own")) + RELATED * best)
    scored = parts.filter("sentence is not null").join(asked, "doc_id").select("doc_id", "level", "pos", "sentence", F.round(score, 9).alias("score"))
    of_doc = Window.partitionBy("doc_id")
    ranked = scored.withColumns({"rank": F.row_number().over(of_doc.orderBy(F.desc("score"), "pos")), "total": F.count(F.lit(1)).over(of_doc)})
    keep = F.greatest(F.lit(1), F.floor(F.col("total") * share / 3))
    said = ranked.withColumn("first", F.min("rank").over(Window.partitionBy("doc_id", "sentence"))).withColumn("stays", (F.col("total") <= 1) | (F.col("first") <= keep))
    short = said.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("stays"), F.struct("pos", "sentence")))).alias("s"), F.first("total").alias("n"))
    short = short.select("doc_id", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("short"), F.size("s").cast("long").alias("k"), "n")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    first = F.when(F.col("level") == "ghost", GHOST_WORDS).otherwise(F.greatest(F.lit(1), F.floor(F.size(words) * share / 3))).cast("int")
    cut = F.when(F.size(words) > first, F.concat(F.array_join(F.slice(words, 1, first), " "), F.lit("...")))
    plain = F.when(F.col("level") == "full", F.col("text")).when((F.col("level") == "ghost") | F.col("vector").isNull(), F.coalesce(cut, F.col("text"))).otherwise(F.col("text"))
    whole = (F.col("n").isNull()) | (F.col("n") <= 1)
    out = docs.join(short, "doc_id", "left")
    return out.select("doc_id", "level", F.when(whole, plain).otherwise(F.col("short")).alias("content"), F.when(whole, F.coalesce("n", F.lit(0))).otherwise(F.col("k")).cast("long").alias("kept"), F.coalesce("n", F.lit(0)).cast("long").alias("total"))
