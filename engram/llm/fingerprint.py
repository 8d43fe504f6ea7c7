"""Operator 2 [native]: document fingerprints, bottom-k sketches of the hashes of five-word shingles.

A sketch is the sorted array of the k smallest distinct hashes, so the sketch of several parts is the k smallest of
their union (merge). Two sketches estimate resemblance (the share of the k smallest of the union that both hold) and
containment; one estimates the number of distinct shingles. Only SQL functions are used.

Words are `[^\\x20\\x09-\\x0D]+` of the lower-cased text; a text of one to four words has one shingle, all its words.
A null or empty text, or one without words, has an empty sketch; two empty sketches resemble each other (1.0), an empty
and another one do not (0.0). Equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import table

K = 128
WORDS = 5
#: Neighbouring documents that are brought together, about.
BUCKET = 500
#: Quantiles of the ids at which ranges begin.
SHARES = [0.0, 1e-5, 1e-4, 1e-3, *[i / 64 for i in range(1, 64)], 0.999, 0.9999, 0.99999]


def shingles(text: Column, words: int = WORDS) -> Column:
    """Hashes of the runs of `words` words."""
    tokens = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.transform(
        F.array(hashed),  # one evaluation of the words' hashes for all uses below
        lambda h: F.when(F.size(h) >= words, F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)])))
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>")),
    )[0]


def sketch(text: Column, k: int = K) -> Column:
    """The k smallest distinct shingle hashes, ascending."""
    return F.slice(F.array_distinct(F.sort_array(shingles(F.coalesce(text, F.lit(""))))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = F.transform(F.array(merge(a, b, k)), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))
    return both[0]


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and sizes."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """doc_id, own and next: structs of the carried columns of a row and of the next one by doc_id (nulls first, in ranges of their hash), then by the carried columns; after the last comes the first.

    doc_id is cut into ranges of about BUCKET rows: at some quantiles of the ids, closer to each other at both ends, and between
    two of these by equal width. So ids far from all others don't widen the ranges of the rest; rows without id fall into
    ranges by the hash of the first column they carry. A window finds the next row inside a range, and the last row of a range gets the
    first row of the next range that has rows. Rows move once: all branches below read one exchange, which carries each text once.
    """
    cuts, low, high, n, nulls = docs.agg(F.percentile_approx("doc_id", SHARES, 1 << 20), F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).head()
    rows = dict(zip(cuts or [], SHARES, strict=False))  # of equal cuts the last share counts
    rows[low or 0] = max(0.0, rows.get(low or 0, 0.0))
    starts = sorted(rows)
    ends, after = [*starts[1:], (high or 0) + 1], [*[rows[c] for c in starts[1:]], 1.0]

    def place(i: int, j: int) -> Column:
        """The range of an id that lies from the i-th start to before the j-th: a search tree of comparisons."""
        if j - i > 1:
            mid = (i + j) // 2
            return F.when(F.col("doc_id") < starts[mid], place(i, mid)).otherwise(place(mid, j))
        many = max(1, round((after[i] - rows[starts[i]]) * n / BUCKET))
        return F.lit(i << 32) + F.floor((F.col("doc_id") - F.lit(starts[i])) / F.lit(max(1, -(-(ends[i] - starts[i]) // many)))).cast("long")

    spread = F.pmod(F.xxhash64(carry[0]), F.lit(max(1, nulls // BUCKET)))
    # never null, or a test for that would part the exchange of one branch from that of the others
    bucket = F.coalesce(F.when(F.col("doc_id").isNull(), spread - F.lit(2**32)).otherwise(place(0, len(starts))), F.lit(-(2**32)))
    docs = docs.select("doc_id", bucket.alias("range"), F.struct(*carry).alias("own"))
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "own")
    rows = docs.withColumns({"next": F.lead("own").over(inside), "first": F.lag("range").over(inside).isNull()})
    heads = rows.filter("first").select(F.col("range").alias("following"), F.col("own").alias("next"))
    # which range follows: first among those between two quantiles, then among these
    ranges = docs.select("range").distinct().withColumn("block", F.shiftright("range", 32))
    lead = F.lead("range").over(Window.partitionBy("block").orderBy("range"))
    blocks = ranges.groupBy("block").agg(F.min("range").alias("begin"))
    every = Window.orderBy("block")
    blocks = blocks.select("block", F.coalesce(F.lead("begin").over(every), F.min("begin").over(Window.partitionBy())).alias("begin"))
    follows = ranges.withColumn("lead", lead).join(blocks, "block").select("range", F.coalesce("lead", "begin").alias("following"))
    last = rows.filter("next is null").select("doc_id", "range", "own").join(follows, "range").join(heads, "following").select("doc_id", "own", "next")
    return rows.filter("next is not null").select("doc_id", "own", "next").unionByName(last)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("sketch", sketch(F.col("text"), k)), ["text", "sketch"])
    n = F.length("own.text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("own.text", F.lit(1), n - cut), F.substring("next.text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.col("own.sketch").alias("sketch"), F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join(F.col("sketch").cast("array<string>"), ",").alias("fingerprint"),
        F.array_join(F.col("edited_sketch").cast("array<string>"), ",").alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
